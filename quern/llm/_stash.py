"""Intermediate tables on storage that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs a re-read of shared files, never lost rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where the setting is missing and all runs in one process (tests)."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set(SETTING, own)
    return own


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stash:
    """A private folder for the tables of one operator call.

    ``put`` writes a table and returns a reader of it; ``drop`` and ``keep`` delete tables
    that no later plan reads; what the returned result still reads goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.names: list[str] = []
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*(set(self.names) - set(names)))

    def _close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
