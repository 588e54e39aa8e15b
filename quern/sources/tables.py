"""Tables as sets of immutable Parquet files, and the manifests that say which sets are live.

A database folder holds ``data/<set>`` and ``manifest/<version>.json``; the highest version is the state. A commit
writes new sets first and then publishes the next manifest at once, so a crash before that leaves the old state, and
a writer that finds the version taken has been overtaken. No file is ever changed.

Rows carry a hidden ``rowid``, given when they are first stored; their order is that of insertion. Columns are
stored as ``c0``, ``c1``, ..., sorted within files by the first index, with Bloom filters on the others' first columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import IntegrityError, SchemaError, StorageError, TransactionError, TypeMismatchError
from quern.functions import values as V
from quern.operators.compiler import Relation

from .files import Files

#: Sets of a table after which they are rewritten as one, and the keys of stored rows that the driver remembers at most.
MOST_SETS, MOST_KEYS = 16, 100_000


@dataclass(frozen=True)
class TableColumn:
    name: str
    type: str
    not_null: bool = False
    primary_key: bool = False
    default: object = None


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool
    origin: str


class Pending:
    """Rows of single INSERTs that wait to be written: (values, rowid), and where each key of a unique index stands.

    Later states of a table share it; ``cut`` takes back what came after an earlier one.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keys: dict[tuple, dict] = {}

    def cut(self, n: int) -> None:
        for held in self.keys.values():
            for key in [k for k, at in held.items() if at >= n]:
                del held[key]
        del self.rows[n:]


@dataclass(frozen=True)
class Table:
    """A state of a table. ``waiting`` rows of ``pending`` belong to it; ``sets`` are folders below ``data``."""

    name: str
    columns: tuple[TableColumn, ...]
    indexes: tuple[Index, ...] = ()
    sets: tuple[str, ...] = ()
    next: int = 1
    pending: Pending | None = None
    waiting: int = 0

    def position(self, name: str) -> int:
        for i, c in enumerate(self.columns):
            if c.name.lower() == name.lower():
                return i
        raise SchemaError(f"table {self.name} has no column {name!r}")

    @property
    def unique(self) -> list[tuple[Index, tuple[int, ...]]]:
        return [(i, tuple(map(self.position, i.columns))) for i in self.indexes if i.unique]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", V.SPARK[c.type.lower()]) for i, c in enumerate(self.columns)] + [T.StructField("rowid", T.LongType())])


def _default(x: object) -> object:
    return {"blob": x.hex()} if isinstance(x, bytes) else x


class Store:
    """The tables of one database folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.version, self.tables = 0, {}
        self._keys: dict[tuple, set] = {}
        #: Sets that no manifest names yet.
        self.staged: list[str] = []
        versions = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if versions:
            self._load(versions[-1])

    def _load(self, name: str) -> None:
        try:
            found = json.loads(self.files.read(f"manifest/{name}"))
            for t in found["tables"]:
                columns = tuple(TableColumn(**c | {"default": bytes.fromhex(c["default"]["blob"]) if isinstance(c["default"], dict) else c["default"]}) for c in t["columns"])
                indexes = tuple(Index(**i | {"columns": tuple(i["columns"])}) for i in t["indexes"])
                self.tables[t["name"].lower()] = Table(t["name"], columns, indexes, tuple(t["sets"]), t["next"])
            self.version = int(name.removesuffix(".json"))
        except (ValueError, KeyError, TypeError) as error:
            raise StorageError(f"manifest {name} cannot be read: {error}") from error

    def publish(self) -> None:
        """Makes the present state the next version."""
        for key, table in list(self.tables.items()):
            table = self.written(table)
            if len(table.sets) > MOST_SETS:
                table = replace(table, sets=(self.stage(table, self.read(table)),))
            self.tables[key] = table
        tables = [
            {"name": t.name, "columns": [asdict(c) | {"default": _default(c.default)} for c in t.columns], "indexes": [asdict(i) for i in t.indexes], "sets": t.sets, "next": t.next}
            for t in self.tables.values()
        ]
        if not self.files.publish(f"manifest/{self.version + 1:012d}.json", json.dumps({"tables": tables})):
            raise TransactionError("another writer has committed meanwhile")
        self.version += 1
        self.staged.clear()

    def discard(self, kept: int = 0) -> None:
        """Deletes sets that were staged after the first ``kept`` ones."""
        for name in self.staged[kept:]:
            self.files.delete(f"data/{name}")
        del self.staged[kept:]

    def vacuum(self) -> None:
        """Deletes sets and manifests that the current version does not need."""
        live = {s for t in self.tables.values() for s in t.sets} | set(self.staged)
        for name in self.files.names("data"):
            if name not in live:
                self.files.delete(f"data/{name}")
        for name in self.files.names("manifest"):
            if name != f"{self.version:012d}.json":
                self.files.delete(f"manifest/{name}")

    # Reading.

    def read(self, table: Table, sets: Sequence[str] | None = None) -> DataFrame:
        """The stored rows: c0, c1, ..., rowid."""
        sets = table.sets if sets is None else sets
        if not sets:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*[f"{self.files.root}/data/{s}" for s in sets])

    def relation(self, table: Table, sets: Sequence[str] | None = None) -> Relation:
        columns = [(c.name, V.Value(F.col(f"c{i}"), c.type.lower())) for i, c in enumerate(table.columns)]
        return Relation(self.read(table, sets), columns, F.col("rowid"), F.col("rowid"), table.indexes)

    # Writing.

    def stage(self, table: Table, rows: DataFrame) -> str:
        """Writes rows (c0, c1, ..., rowid and what else they have) as a new set."""
        name = uuid.uuid4().hex
        self.staged.append(name)
        places = [table.position(i.columns[0]) for i in table.indexes]
        if places and table.columns[places[0]].type != "ANY":
            rows = rows.sortWithinPartitions(f"c{places[0]}")
        writer = rows.write
        for at in places[1:]:
            writer = writer.option(f"parquet.bloom.filter.enabled#c{at}", "true")
        writer.parquet(f"{self.files.root}/data/{name}")
        return name

    def written(self, table: Table) -> Table:
        """The table with its waiting rows in a set."""
        if not table.waiting:
            return table
        rows = self.spark.createDataFrame([(*v, rowid) for v, rowid in table.pending.rows[: table.waiting]], table.schema).coalesce(1)
        return replace(table, sets=(*table.sets, self.stage(table, rows)), pending=None, waiting=0)

    def checked(self, table: Table, rows: DataFrame, bad: Column) -> tuple[str, int, int]:
        """Stages rows whose ``bad`` is 0, or the number of a column with a value it cannot hold, or minus that for a null that it must not."""
        name = self.stage(table, rows.withColumn("bad", bad))
        found = self.spark.read.parquet(f"{self.files.root}/data/{name}").agg(F.min("bad"), F.max("bad"), F.count("*"), F.max("rowid")).first()
        if found[0] is not None and found[0] < 0:
            raise IntegrityError(f"NOT NULL constraint failed: {table.name}.{table.columns[-found[0] - 1].name}")
        if found[1]:
            column = table.columns[found[1] - 1]
            raise TypeMismatchError(f"a value cannot be stored in {table.name}.{column.name} ({column.type})")
        return name, found[2], found[3] or 0

    def violated(self, table: Table, columns: list[V.Value]) -> Column:
        """``bad`` of the rows with these values, to be stored in the table's columns."""
        out = F.lit(0)
        for i, (c, v) in reversed(list(enumerate(zip(table.columns, columns, strict=True)))):
            stored, wrong = V.stored(v, c.type)
            if c.not_null:
                out = F.when(stored.isNull() & ~wrong, -i - 1).otherwise(out)
            out = F.when(wrong, i + 1).otherwise(out)
        return out

    def no_repeats(self, table: Table, sets: Sequence[str], among: Sequence[str] = ()) -> None:
        """Raises if ``sets`` hold a unique key twice, or one that ``among`` holds as well."""
        for index, places in table.unique:
            names = [f"c{p}" for p in places]
            new = self.read(table, sets).select(*names).na.drop()
            repeated = new.groupBy(*names).count().filter("count > 1")
            if not repeated.isEmpty() or among and not new.join(self.read(table, among).select(*names), names, "left_semi").isEmpty():
                raise _repeated(table, index)

    def add(self, table: Table, rows: list[list]) -> Table:
        """The table with rows of Python values that wait to be written."""
        pending = table.pending or Pending()
        start = table.waiting
        try:
            for row in rows:
                values = tuple(held(x, c, table) for x, c in zip(row, table.columns, strict=True))
                at = len(pending.rows)
                for index, places in table.unique:
                    key = tuple(_comparable(values[p]) for p in places)
                    seen = pending.keys.setdefault(places, {})
                    if None in key:
                        continue
                    if key in seen or self._stored(table, places, key):
                        raise _repeated(table, index)
                    seen[key] = at
                pending.rows.append((values, table.next + at - start))
        except Exception:
            pending.cut(start)
            raise
        return replace(table, pending=pending, waiting=len(pending.rows), next=table.next + len(rows))

    def _stored(self, table: Table, places: tuple, key: tuple) -> bool:
        """Whether a stored row has the key: by the remembered keys of a small table, else by a query."""
        if not table.sets:
            return False
        names = [f"c{p}" for p in places]
        at = (table.sets, places)
        if at not in self._keys:
            stored = self.read(table).select(*names).na.drop()
            rows = stored.limit(MOST_KEYS + 1).collect()
            if len(self._keys) >= 8:
                self._keys.clear()
            self._keys[at] = {tuple(_comparable(x) for x in r) for r in rows} if len(rows) <= MOST_KEYS else None
        if self._keys[at] is not None:
            return key in self._keys[at]
        df = self.read(table)
        for n, p, x in zip(names, places, key, strict=True):
            df = df.filter(F.col(n) == F.lit(x)) if table.columns[p].type != "ANY" else df.filter(V.compare("=", V.Value(F.col(n), "any"), V.constant(x)).col)
        return not df.isEmpty()


def _repeated(table: Table, index: Index) -> IntegrityError:
    return IntegrityError(f"{'PRIMARY KEY' if index.origin == 'PRIMARY KEY' else 'UNIQUE'} constraint failed: {', '.join(f'{table.name}.{c}' for c in index.columns)}")


def _comparable(x: object) -> object:
    """A stored value as it is compared: the value of an any, in which 1 and 1.0 are one key."""
    return V.shown(x) if hasattr(x, "asDict") else x[2 if x[0] == 2 else 3 if x[0] == 3 else 1] if isinstance(x, tuple) else bytes(x) if isinstance(x, bytearray) else x


def held(x: object, column: TableColumn, table: Table) -> object:
    """A Python value as its column stores it."""
    if x is None:
        if column.not_null:
            raise IntegrityError(f"NOT NULL constraint failed: {table.name}.{column.name}")
        return None
    if isinstance(x, bool):
        x = int(x)
    if isinstance(x, bytearray | memoryview):
        x = bytes(x)
    if not isinstance(x, int | float | str | bytes):
        raise TypeMismatchError(f"unsupported value {x!r}")
    wrong = TypeMismatchError(f"cannot store {x!r} in {table.name}.{column.name} ({column.type})")
    try:
        match column.type:
            case "INTEGER":
                if isinstance(x, bytes) or isinstance(x, float) and not x.is_integer() or isinstance(x, str) and "_" in x:
                    raise wrong
                x = int(x)
                if not -(1 << 63) <= x < 1 << 63:
                    raise wrong
            case "REAL":
                if isinstance(x, bytes) or isinstance(x, str) and not any(c.isdigit() for c in x) or isinstance(x, str) and "_" in x:
                    raise wrong
                x = float(x)
            case "TEXT":
                if isinstance(x, bytes):
                    raise wrong
                x = spelled(x)
            case "BLOB":
                if not isinstance(x, bytes | str):
                    raise wrong
                x = x.encode() if isinstance(x, str) else x
            case "ANY":
                if isinstance(x, int | float):
                    kind = "integer" if isinstance(x, int) else "real"
                    return (1, float(x), None, None, kind, x if kind == "integer" else None)
                return (2, None, x, None, "text", None) if isinstance(x, str) else (3, None, None, x, "blob", None)
    except (ValueError, OverflowError):
        raise wrong from None
    return x


def spelled(x: object) -> str:
    """The text form of a number or a text."""
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e16:
        return str(int(x))
    return repr(x) if isinstance(x, float) else str(x)
