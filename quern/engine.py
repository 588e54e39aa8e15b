"""The database: ``connect`` a folder, then run statements of the dialect in transactions."""

from __future__ import annotations

import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QuernError, SchemaError, TransactionError
from quern.functions import values as V
from quern.operators import compiler
from quern.operators import syntax as X
from quern.sources.tables import Index, Store, Table, TableColumn


class Result:
    """What a statement gave. ``df`` is the plan of a SELECT, of which ``rows`` collects the rows once they are asked for."""

    def __init__(self, columns: Sequence[str] = (), rows: list[tuple] | None = None, rowcount: int = 0, message: str | None = None, plan: Sequence[str] = (), source=None) -> None:
        self.columns, self.rowcount, self.message, self.plan = list(columns), rowcount, message, list(plan)
        self._rows, self._source = rows, source

    @property
    def df(self) -> DataFrame | None:
        return self._source and self._source(False).flat()

    @property
    def rows(self) -> list[tuple]:
        if self._rows is None:
            with _translated():
                self._rows = [tuple(map(V.shown, r)) for r in self._source(True).ordered().collect()] if self._source else []
        return self._rows

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    def __repr__(self) -> str:
        return f"Result(columns={self.columns!r}, message={self.message!r})"

    def dicts(self) -> list[dict]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows]

    def scalar(self) -> object:
        return self.rows[0][0] if self.rows and self.rows[0] else None


@contextlib.contextmanager
def _translated() -> Iterator[None]:
    """Spark's errors as the engine's."""
    try:
        yield
    except PySparkException as error:
        raise QuernError(str(error).split("\n")[0]) from error


def _counted(n: int, what: str) -> Result:
    return Result(rowcount=n, message=f"{n} row{'' if n == 1 else 's'} {what}")


class Database:
    """One folder of tables and one session. Statements commit by themselves unless a transaction is open.

    A statement that fails leaves nothing behind, in a transaction too; a UNIQUE key is judged on the state after the
    statement. ``register`` adds read-only tables of Parquet files.
    """

    def __init__(self, path: str = ":memory:", spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self._own = None
        if path == ":memory:":
            shared = self.spark.conf.get("spark.checkpoint.dir", None)
            if shared is None and not re.fullmatch(r"local(\[.*\])?", self.spark.sparkContext.master):
                raise QuernError("spark.checkpoint.dir must name a folder that all executors share")
            self._own = tempfile.mkdtemp(prefix="quern-") if shared is None else None
            path = self._own or f"{shared.rstrip('/')}/quern-{uuid.uuid4().hex}"
            self._passing = True
        else:
            self._passing = False
        self.path, self.store = path, Store(self.spark, path)
        self.external: dict[str, compiler.Relation | str] = {}
        self._before: dict[str, Table] | None = None
        self._closed = False

    # Catalog.

    def register(self, name: str, path: str) -> None:
        """A read-only table over Parquet files, which are looked at when a statement first names it.

        Its scan order is that of files and their rows; columns of types that the dialect lacks are left out.
        """
        self.external[name.lower()] = path

    def _external(self, key: str) -> compiler.Relation:
        found = self.external[key]
        if isinstance(found, str):
            df = self.spark.read.parquet(found)
            columns = [(f.name, v) for f in df.schema if (v := V.typed(F.col(f"`{f.name}`"), f.dataType))]
            row = F.col("_metadata.row_index")
            one = len(df.inputFiles()) <= 1
            order = row if one else F.struct(F.col("_metadata.file_path"), row)
            found = self.external[key] = compiler.Relation(df, columns, order, row if one else None)
        return found

    def table(self, name: str) -> Table:
        found = self.store.tables.get(name.lower())
        if found is None:
            raise SchemaError(f"table {name} is read-only" if name.lower() in self.external else f"no such table: {name}")
        return found

    def _relation(self, name: str) -> compiler.Relation:
        key = name.lower()
        if key in self.external:
            return self._external(key)
        table = self.store.tables[key] = self.store.written(self.table(name))
        return self.store.relation(table)

    @property
    def table_names(self) -> list[str]:
        return sorted(t.name for t in self.store.tables.values())

    def schema(self) -> list[dict]:
        tables = [self.table(n) for n in self.table_names]
        return [
            {
                "table": t.name,
                "columns": [{"name": c.name, "type": c.type, "not_null": c.not_null, "primary_key": c.primary_key, "default": c.default} for c in t.columns],
                "indexes": [{"name": i.name, "columns": list(i.columns), "unique": i.unique, "origin": i.origin} for i in t.indexes],
            }
            for t in tables
        ]

    # Transactions.

    @property
    def in_transaction(self) -> bool:
        return self._before is not None

    def begin(self) -> None:
        if self.in_transaction:
            raise TransactionError("a transaction is already open")
        self._before = dict(self.store.tables)

    def commit(self) -> None:
        if not self.in_transaction:
            raise TransactionError("no transaction to commit")
        try:
            with _translated():
                self.store.publish()
        except Exception:
            self.rollback()
            raise
        self._before = None

    def rollback(self) -> None:
        if not self.in_transaction:
            raise TransactionError("no transaction to roll back")
        self._restore(self._before, 0)
        self._before = None

    def _restore(self, tables: dict[str, Table], staged: int) -> None:
        for t in tables.values():
            if t.pending:
                t.pending.cut(t.waiting)
        self.store.tables = tables
        self.store.discard(staged)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Database]:
        """Commits at the end of the block, rolls back if it raises."""
        self.begin()
        try:
            yield self
        except BaseException:
            if self.in_transaction:
                self.rollback()
            raise
        if self.in_transaction:
            self.commit()

    @contextlib.contextmanager
    def _statement(self) -> Iterator[None]:
        """All or nothing of one statement, committed at once outside a transaction."""
        alone = not self.in_transaction
        if alone:
            self.begin()
        tables, staged = dict(self.store.tables), len(self.store.staged)
        try:
            with _translated():
                yield
        except BaseException:
            self._restore(tables, staged)
            if alone:
                self._before = None
            raise
        if alone:
            self.commit()

    # Statements.

    def execute(self, sql: str, params: Sequence = ()) -> Result:
        """Runs all statements of a script and gives the last one's result."""
        if self._closed:
            raise QuernError("database is closed")
        result = Result(message="no statement")
        for tree in X.parse(sql):
            result = self._run(tree, params)
        return result

    def executemany(self, sql: str, sequence: Iterable[Sequence]) -> Result:
        """One statement for each set of parameters, in one transaction; rows of INSERTs are written together."""
        trees = X.parse(sql)
        if len(trees) != 1:
            raise QuernError("executemany() takes one statement")
        with contextlib.nullcontext() if self.in_transaction else self.transaction():
            n = sum(self._run(trees[0], params).rowcount for params in sequence)
        return Result(rowcount=n, message=f"{n} rows affected")

    def query(self, sql: str, params: Sequence = ()) -> list[tuple]:
        return self.execute(sql, params).rows

    def scalar(self, sql: str, params: Sequence = ()) -> object:
        return self.execute(sql, params).scalar()

    def _run(self, tree: object, params: Sequence) -> Result:
        match tree:
            case X.Select():
                return self._select(tree, params)
            case X.Explain(X.Select() as inner):
                lines = self._plan(inner, params).lines
                return Result(["detail"], [(x,) for x in lines], plan=lines)
            case X.Explain(inner):
                return Result(["detail"], [(f"{type(inner).__name__.upper()} statement",)])
            case X.Transaction(action):
                getattr(self, action.lower())()
                return Result(message=action)
        with self._statement():
            return getattr(self, f"_{type(tree).__name__.lower()}")(tree, params)

    def _plan(self, tree: X.Select, params: Sequence, ordered: bool = False) -> compiler.Plan:
        with _translated():
            return compiler.select(tree, self._relation, self.spark, params, ordered=ordered)

    def _select(self, tree: X.Select, params: Sequence) -> Result:
        plan = self._plan(tree, params)
        # The plan reads the sets that are live now, whatever later statements do.
        tables = {s.table.lower(): self._relation(s.table) for s in tree.sources}
        again = lambda ordered: compiler.select(tree, lambda n: tables[n.lower()], self.spark, params, ordered=ordered)
        result = Result(plan.names, plan=plan.lines, source=again)
        if self.in_transaction and not tables.keys() <= self.external.keys():
            result.rows  # noqa: B018  a rollback would delete sets before the rows are asked for
        return result

    def _createtable(self, tree: X.CreateTable, params: Sequence) -> Result:
        key = tree.name.lower()
        if key in self.store.tables or key in self.external:
            if tree.if_not_exists:
                return Result(message=f"table {tree.name} already exists")
            raise SchemaError(f"table {tree.name} already exists")
        columns: list[TableColumn] = []
        for c in tree.columns:
            if c.name.lower() == "rowid":
                raise SchemaError("'rowid' is reserved and cannot be a column name")
            if any(x.name.lower() == c.name.lower() for x in columns):
                raise SchemaError(f"duplicate column name: {c.name}")
            default = None if c.default is None else compiler.constant(c.default, self.spark, params)
            columns.append(TableColumn(c.name, V.declared(c.type), c.not_null, c.primary_key, default))
        table = Table(tree.name, tuple(columns))
        primary, indexes = [c.name for c in columns if c.primary_key], []
        for kind, names in tree.constraints:
            for n in names:
                table.position(n)
            if kind == "UNIQUE":
                indexes.append(Index(f"sqlite_autoindex_{tree.name}_{len(indexes) + 1}", names, True, kind))
            elif primary:
                raise SchemaError(f"table {tree.name} has more than one primary key")
            else:
                primary = list(names)
        if primary:
            indexes.append(Index(f"{tree.name}_pkey", tuple(primary), True, "PRIMARY KEY"))
        indexes += [Index(f"{tree.name}_{c.name}_key", (c.name,), True, "UNIQUE") for c in tree.columns if c.unique and not c.primary_key]
        keys = {n.lower() for n in primary}
        columns = [replace(c, primary_key=True, not_null=True) if c.name.lower() in keys else c for c in columns]
        self.store.tables[key] = Table(tree.name, tuple(columns), tuple(indexes))
        return Result(message=f"CREATE TABLE {tree.name}")

    def _droptable(self, tree: X.DropTable, params: Sequence) -> Result:
        if tree.if_exists and tree.name.lower() not in self.store.tables:
            return Result(message=f"no such table: {tree.name}")
        self.table(tree.name)
        del self.store.tables[tree.name.lower()]
        return Result(message=f"DROP TABLE {tree.name}")

    def _owner(self, index: str) -> tuple[Table, Index] | None:
        return next(((t, i) for t in self.store.tables.values() for i in t.indexes if i.name.lower() == index.lower()), None)

    def _createindex(self, tree: X.CreateIndex, params: Sequence) -> Result:
        if self._owner(tree.name):
            if tree.if_not_exists:
                return Result(message=f"index {tree.name} already exists")
            raise SchemaError(f"index {tree.name} already exists")
        table = self.store.written(self.table(tree.table))
        index = Index(tree.name, tuple(table.columns[table.position(c)].name for c in tree.columns), tree.unique, "CREATE INDEX")
        new = replace(table, indexes=(*table.indexes, index))
        if tree.unique:
            self.store.no_repeats(replace(new, indexes=(index,)), table.sets)
        # Stored rows take the layout that the indexes ask for.
        self.store.tables[tree.table.lower()] = replace(new, sets=(self.store.stage(new, self.store.read(table)),)) if table.sets else new
        return Result(message=f"CREATE INDEX {tree.name}")

    def _dropindex(self, tree: X.DropIndex, params: Sequence) -> Result:
        found = self._owner(tree.name)
        if not found:
            if tree.if_exists:
                return Result(message=f"no such index: {tree.name}")
            raise SchemaError(f"no such index: {tree.name}")
        table, index = found
        if index.origin != "CREATE INDEX":
            raise SchemaError(f"index {tree.name} implements a constraint and cannot be dropped")
        self.store.tables[table.name.lower()] = replace(table, indexes=tuple(i for i in table.indexes if i is not index))
        return Result(message=f"DROP INDEX {tree.name}")

    def _insert(self, tree: X.Insert, params: Sequence) -> Result:
        table = self.table(tree.table)
        places = list(range(len(table.columns))) if tree.columns is None else [table.position(c) for c in tree.columns]
        if len(set(places)) < len(places):
            raise SchemaError("a column is named twice in INSERT")
        if tree.select is not None:
            return self._insert_select(tree.select, table, places, params)
        for row in tree.rows:
            if len(row) != len(places):
                raise QuernError(f"INSERT has {len(places)} target columns but {len(row)} values")
        rows = []
        for given in self._constants(tree.rows, params):
            row = [c.default for c in table.columns]
            for at, x in zip(places, given, strict=True):
                row[at] = x
            rows.append(row)
        self.store.tables[tree.table.lower()] = self.store.add(table, rows)
        return _counted(len(rows), "inserted")

    def _constants(self, rows: Sequence[Sequence], params: Sequence) -> list[list]:
        """The values of constant expressions; those that need Spark in one job."""
        plain = lambda n: isinstance(n, X.Literal | X.Param) or isinstance(n, X.Unary) and n.op == "-" and isinstance(n.operand, X.Literal) and isinstance(n.operand.value, int | float)
        odd = [n for row in rows for n in row if not plain(n)]
        found: dict[int, object] = {}
        if odd:
            tree = X.Select(tuple(X.Item(n, None) for n in odd))
            found = {id(n): x for n, x in zip(odd, self._select(tree, params).rows[0], strict=True)}
        return [[found[id(n)] if id(n) in found else compiler.constant(n, self.spark, params) for n in row] for row in rows]

    def _insert_select(self, tree: X.Select, table: Table, places: list[int], params: Sequence) -> Result:
        plan = self._plan(tree, params, ordered=True)
        if len(plan.values) != len(places):
            raise QuernError(f"INSERT has {len(places)} target columns but the SELECT produced {len(plan.values)}")
        table = self.store.written(self.table(table.name))
        given = dict(zip(places, [replace(v, col=F.col(f"c{i}")) for i, v in enumerate(plan.values)], strict=True))
        columns = [given.get(i) or V.constant(c.default) for i, c in enumerate(table.columns)]
        rowid = (F.monotonically_increasing_id() + table.next).alias("rowid")
        rows = plan.ordered().select("*", rowid, self.store.violated(table, columns).alias("bad"))
        rows = rows.select(*[V.stored(v, c.type)[0].alias(f"c{i}") for i, (c, v) in enumerate(zip(table.columns, columns, strict=True))], "rowid", "bad")
        name, n, last = self.store.checked(table, rows, F.col("bad"))
        self.store.no_repeats(table, (name,), table.sets)
        self.store.tables[table.name.lower()] = replace(table, sets=(*table.sets, name), next=max(table.next, last + 1))
        return _counted(n, "inserted")

    def _matching(self, table: Table, where: object, params: Sequence) -> tuple[compiler._Scope, object, dict[str, tuple[int, int]]]:
        """The scope of a table's rows, the condition, and for each set its rows and those that fulfil it, in one job."""
        relation = self.store.relation(table)
        scope = compiler.row_scope(table.name, relation, params)
        hit = F.lit(True) if where is None else F.coalesce(V.truth(compiler.value(where, scope)), F.lit(False))
        if not table.sets:
            return scope, hit, {}
        parts = [self.store.read(table, (s,)).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("name", F.lit(s)) for s in table.sets]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        return scope, hit, {r["name"]: (r["n"], r["hits"]) for r in every.collect()}

    def _update(self, tree: X.Update, params: Sequence) -> Result:
        table = self.store.written(self.table(tree.table))
        targets = {table.position(c): expr for c, expr in tree.sets}
        scope, hit, found = self._matching(table, tree.where, params)
        changes = {at: compiler.value(expr, scope).plain for at, expr in targets.items()}
        touched = tuple(s for s in table.sets if found[s][1])
        if touched:
            old = [V.Value(F.col(f"c{i}"), c.type.lower()) for i, c in enumerate(table.columns)]
            new = [changes.get(i, v) for i, v in enumerate(old)]
            columns = [F.when(hit, V.stored(v, c.type)[0]).otherwise(F.col(f"c{i}")).alias(f"c{i}") if i in changes else F.col(f"c{i}") for i, (c, v) in enumerate(zip(table.columns, new, strict=True))]
            bad = F.when(hit, self.store.violated(table, new)).otherwise(0).alias("bad")
            name, _, _ = self.store.checked(table, self.store.read(table, touched).select(*columns, "rowid", bad), F.col("bad"))
            kept = tuple(s for s in table.sets if s not in touched)
            keys = tuple(i for i in table.indexes if i.unique and any(table.position(c) in changes for c in i.columns))
            self.store.no_repeats(replace(table, indexes=keys), (name,), kept)
            table = replace(table, sets=(*kept, name))
        self.store.tables[table.name.lower()] = table
        return _counted(sum(h for _, h in found.values()), "updated")

    def _delete(self, tree: X.Delete, params: Sequence) -> Result:
        table = self.store.written(self.table(tree.table))
        _, hit, found = self._matching(table, tree.where, params)
        kept = tuple(s for s in table.sets if not found[s][1])
        part = tuple(s for s in table.sets if 0 < found[s][1] < found[s][0])
        if part:
            kept = (*kept, self.store.stage(table, self.store.read(table, part).filter(~hit)))
        self.store.tables[table.name.lower()] = replace(table, sets=kept)
        return _counted(sum(h for _, h in found.values()), "deleted")

    # Lifecycle.

    def vacuum(self) -> None:
        """Deletes files that only earlier versions need. Not while another process reads or writes the folder."""
        if self.in_transaction:
            raise TransactionError("a transaction is open")
        self.store.vacuum()

    def close(self) -> None:
        """Rolls back an open transaction; a database in memory is deleted."""
        if self._closed:
            return
        if self.in_transaction:
            self.rollback()
        self._closed = True
        if self._passing:
            self.store.files.delete("")
        if self._own:
            shutil.rmtree(self._own, ignore_errors=True)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"<Database {self.path}: {len(self.store.tables)} tables>"


def connect(path: str = ":memory:", spark: SparkSession | None = None) -> Database:
    """Opens or creates the database in a folder; ``:memory:`` is one that lasts until it is closed."""
    return Database(path, spark)
