"""Small files of a database folder: listing, reading, deleting, and publishing a file that must not exist yet.

Local folders go through the operating system, whose hard links are atomic and exclusive; other stores through
Hadoop's file system, whose rename is.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.local = None
        if "://" not in root and not root.startswith("file:"):
            self.local = os.path.abspath(root)
            self.root = f"file://{self.local}"
        elif root.startswith("file:"):
            self.local = "/" + self.root.removeprefix("file:").lstrip("/")

    def _hadoop(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def names(self, folder: str) -> list[str]:
        if self.local:
            where = os.path.join(self.local, folder)
            return sorted(os.listdir(where)) if os.path.isdir(where) else []
        store, target = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []

    def read(self, path: str) -> str:
        if self.local:
            with open(os.path.join(self.local, path), encoding="utf-8") as file:
                return file.read()
        store, target = self._hadoop(path)
        stream = store.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Makes the whole file appear at once; False if there is one already."""
        if self.local:
            return self._publish_local(os.path.join(self.local, path), text)
        store, target = self._hadoop(path)
        _, draft = self._hadoop(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = store.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not store.exists(target) and store.rename(draft, target)
        if not done:
            store.delete(draft, False)
        return done

    def _publish_local(self, target: str, text: str) -> bool:
        folder = os.path.dirname(target)
        os.makedirs(folder, exist_ok=True)
        draft = f"{target}.{uuid.uuid4().hex}.tmp"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        at = os.open(folder, os.O_RDONLY)
        os.fsync(at)
        os.close(at)
        return True

    def delete(self, path: str) -> None:
        if self.local:
            where = os.path.join(self.local, path)
            if os.path.isdir(where):
                shutil.rmtree(where, ignore_errors=True)
            elif os.path.exists(where):
                os.unlink(where)
            return
        store, target = self._hadoop(path)
        store.delete(target, True)
