"""SELECT trees as DataFrames: names and storage classes are settled here, the rest is left to Catalyst.

Every source column gets a name of its own (``s<source>_<column>``) and every source an order key ``s<source>_o``, which
gives rows the scan order of nested loops: ties of ORDER BY, the first row of a group and LIMIT without ORDER BY follow
it. Where no answer depends on it, the key is a constant and costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QuernError, SchemaError
from quern.functions import semantics as S
from quern.functions import values as V
from quern.functions.values import Value

from . import syntax as X


@dataclass(frozen=True)
class Relation:
    """A table as queries see it: its columns' names and values, an order key, and the rowid if it has one."""

    df: DataFrame
    columns: list[tuple[str, Value]]
    order: Column
    rowid: Column | None = None
    indexes: tuple = ()


@dataclass
class _Scope:
    """What names mean: ``columns`` are (alias, name, value) of the sources so far, ``rowids`` (alias, value)."""

    columns: list[tuple[str, str, Value]] = field(default_factory=list)
    rowids: list[tuple[str, Value | None]] = field(default_factory=list)
    shown: list[str] = field(default_factory=list)
    params: Sequence = ()
    #: Values of aggregate calls and of grouping expressions, where they stand for themselves.
    known: dict = field(default_factory=dict)

    def find(self, name: X.Name) -> Value:
        table, column = name.table and name.table.lower(), name.name.lower()
        if column == "rowid":
            found = [v for a, v in self.rowids if table in (None, a)][:1]
            if found and found[0] is None:
                raise SchemaError("the table has no rowid")
        else:
            found = [v for a, n, v in self.columns if n == column and table in (None, a)]
        if len(found) != 1:
            raise SchemaError(f"{'ambiguous column name' if found else 'no such column'}: {X.described(name)}")
        return found[0]


def value(node: object, scope: _Scope) -> Value:
    """An expression as a column."""
    if node in scope.known:
        return scope.known[node]
    one = lambda x: value(x, scope)
    flip = lambda c, negated: V.boolean(~c if negated else c)
    match node:
        case X.Literal(x):
            return V.constant(x)
        case X.Param(i):
            if i >= len(scope.params):
                raise QuernError(f"no value for parameter {i + 1}")
            return V.constant(scope.params[i])
        case X.Name():
            return scope.find(node)
        case X.Unary("NOT", x):
            return V.boolean(~V.truth(one(x)))
        case X.Unary("-", X.Literal(int() | float() as x)):
            # The least integer is within 64 bits, its digits alone are not.
            return V.constant(-x)
        case X.Unary(_, x):
            return V.negative(one(x))
        case X.Binary("AND", a, b):
            return V.boolean(V.truth(one(a)) & V.truth(one(b)))
        case X.Binary("OR", a, b):
            return V.boolean(V.truth(one(a)) | V.truth(one(b)))
        case X.Binary("||", a, b):
            return Value(F.concat(V.text(one(a)), V.text(one(b))), "text")
        case X.Binary("IS" | "IS NOT" as op, a, b):
            return flip(V.same(one(a), one(b)), op == "IS NOT")
        case X.Binary(op, a, b) if op in X.COMPARISONS:
            return V.compare(op, one(a), one(b))
        case X.Binary(op, a, b):
            return V.arithmetic(op, one(a), one(b))
        case X.IsNull(x, negated):
            v = one(x).plain
            return flip(v.col.isNull(), negated)
        case X.In(x, items, negated):
            return flip(_member(one(x), [one(i) for i in items]), negated)
        case X.Between(x, low, high, negated):
            x, low, high = one(x), one(low), one(high)
            inside = V.compare(">=", x, low).col & V.compare("<=", x, high).col
            return flip(F.when(x.plain.col.isNotNull() & low.plain.col.isNotNull() & high.plain.col.isNotNull(), inside) if _may_be_null(low, high) else inside, negated)
        case X.Like(x, pattern, negated):
            return flip(V.like(one(x), one(pattern)), negated)
        case X.Case():
            return _case(node, one)
        case X.Call(name, args, _, star):
            if _aggregate(node):
                raise SchemaError(f"misuse of aggregate function {name}()")
            if star or node.distinct:
                raise QuernError(f"{name}() takes neither * nor DISTINCT")
            return V.scalar(name, [one(a) for a in args])
    raise QuernError(f"unsupported expression {node!r}")


def _may_be_null(*values: Value) -> bool:
    """Null bounds decide by themselves; literal ones cannot be null and keep the plain, pushable form."""
    return not all(v.literal is not None for v in values)


def _member(x: Value, items: list[Value]) -> Column:
    if not items:
        return F.when(x.plain.col.isNotNull(), F.lit(False))
    found = None
    for item in items:
        one = V.compare("=", x, item).col
        found = one if found is None else found | one
    return found


def _case(node: X.Case, one: Callable) -> Value:
    operand = None if node.operand is None else one(node.operand)
    tests = [V.truth(one(c)) if operand is None else V.matches(operand, one(c)) for c, _ in node.branches]
    results = V.unified([one(r) for _, r in node.branches] + [V.null() if node.otherwise is None else one(node.otherwise)])
    out = None
    for test, result in zip(tests, results, strict=False):
        out = F.when(test, result.col) if out is None else out.when(test, result.col)
    return Value(out.otherwise(results[-1].col), results[-1].kind, numeric=results[-1].numeric)


def _aggregate(node: object) -> bool:
    return isinstance(node, X.Call) and node.name in V.AGGREGATES and (node.name not in ("MIN", "MAX") or len(node.args) < 2)


def _aggregates(node: object) -> list[X.Call]:
    """The aggregate calls of an expression, each once."""
    if _aggregate(node):
        return [node]
    return list(dict.fromkeys(c for x in X.parts(node) for c in _aggregates(x)))


@dataclass(frozen=True)
class Plan:
    """A compiled SELECT. ``df`` has the values' columns ``c0``, ``c1``, ... and ``order`` for rows in scan order."""

    df: DataFrame
    names: list[str]
    values: list[Value]
    order: list[Column]
    lines: list[str]

    def flat(self) -> DataFrame:
        """The result as a plain table, in no particular order unless the statement gives one."""
        return self.df.select(*[V.flat(v).alias(n) for n, v in zip(self.names, self.values, strict=True)])

    def ordered(self) -> DataFrame:
        """The raw values in the result's order."""
        df = self.df.orderBy(*self.order) if self.order else self.df
        return df.select(*[v.col.alias(f"c{i}") for i, v in enumerate(self.values)])


def _scan_order_matters(tree: X.Select, ordered: bool) -> bool:
    """Whether the answer, or the order of rows where it is ``ordered``, depends on the order of a scan."""
    exprs = [i.expr for i in tree.items]
    said = [*exprs, tree.having, *(o.expr for o in tree.order_by)]
    calls = [c for x in said for c in _aggregates(x)]
    keys = {o.expr for o in tree.order_by}
    keys |= {i.expr for i in tree.items for o in tree.order_by if isinstance(o.expr, X.Name) and i.alias and i.alias.lower() == o.expr.name.lower()}
    keys |= {exprs[o.expr.value - 1] for o in tree.order_by if isinstance(o.expr, X.Literal) and isinstance(o.expr.value, int) and 0 < o.expr.value <= len(exprs)}
    if any(c.name == "GROUP_CONCAT" for c in calls):
        return True
    if tree.group_by or calls:
        if any(isinstance(x, X.Star) or _free(x, set(tree.group_by)) for x in exprs + [tree.having]):
            return True
        if not tree.group_by or keys.issuperset(tree.group_by):
            return False
    elif tree.distinct:
        if not keys.issubset(exprs):
            return True
        if keys.issuperset(exprs):
            return False
    return ordered or tree.limit is not None


def select(tree: X.Select, table: Callable[[str], Relation], spark: SparkSession, params: Sequence = (), *, ordered: bool = False) -> Plan:
    """The plan of a SELECT over the tables that ``table`` finds; ``ordered``: rows without ORDER BY come in scan order."""
    scope = _Scope(params=params)
    df, relations = _sources(tree, table, spark, scope, _scan_order_matters(tree, ordered))
    lines = _lines(tree, relations, scope)
    items = _expanded(tree, scope)
    order = F.struct(*[F.col(f"s{i}_o").alias(f"o{i}") for i in range(len(relations))]) if len(relations) > 1 else F.col("s0_o") if relations else F.lit(0)
    if tree.where is not None:
        df = df.filter(V.truth(value(tree.where, scope)))
    said = [expr for expr, _ in items] + [o.expr for o in tree.order_by] + [tree.having]
    wanted = list(dict.fromkeys(x for expr in said for x in _aggregates(expr)))
    if tree.group_by or wanted:
        df, scope, order = _grouped(df, tree, wanted, said, scope, order)
        if tree.having is not None:
            df = df.filter(V.truth(value(tree.having, scope)))
    outputs = [value(expr, scope).plain for expr, _ in items]
    keys = [_order_key(o.expr, items, outputs, scope) for o in tree.order_by]

    # Outputs, sort keys that are none, and the order key become columns, so that what follows needs no source.
    hidden = [V.key(v).alias(f"k{i}") for i, (_, v, at) in enumerate(keys) if at is None]
    df = df.select(*[v.col.alias(f"c{i}") for i, v in enumerate(outputs)], *hidden, order.alias("o"))
    outputs = [Value(F.col(f"c{i}"), v.kind, numeric=v.numeric) for i, v in enumerate(outputs)]
    if tree.distinct:
        first = F.min(F.struct("o", *[F.col(c) for c in df.columns if c.startswith("k")])).alias("f")
        df = df.groupBy(*[f"c{i}" for i in range(len(outputs))]).agg(first).select(*[f"c{i}" for i in range(len(outputs))], "f.*")
    sorts = [F.col(f"k{i}") if at is None else V.key(outputs[at]) for i, (_, _, at) in enumerate(keys)]
    by = [c.desc() if o.descending else c.asc() for c, o in zip(sorts, tree.order_by, strict=True)]
    nodes, places = {n for n, _, _ in keys}, {at for _, _, at in keys}
    # Keys that tell all rows apart need no scan order.
    if not (tree.group_by and nodes.issuperset(tree.group_by) or wanted and not tree.group_by or tree.distinct and places.issuperset(range(len(outputs)))):
        by.append(F.asc("o"))
    limit, offset = _number(tree.limit, spark, params), _number(tree.offset, spark, params)
    if by and (keys or limit is not None or offset):
        df = df.orderBy(*by)
    if offset and offset > 0:
        df = df.offset(offset)
    if limit is not None and limit >= 0:
        df = df.limit(limit)
    return Plan(df, [name for _, name in items], outputs, by if relations else [], lines)


def _sources(tree: X.Select, table: Callable[[str], Relation], spark: SparkSession, scope: _Scope, ordered: bool) -> tuple[DataFrame, list[Relation]]:
    df, relations = spark.range(1).select(F.lit(0).alias("one")), []
    for i, source in enumerate(tree.sources):
        alias = source.alias.lower()
        if any(a == alias for a, _ in scope.rowids):
            raise SchemaError(f"duplicate table alias: {source.alias}")
        relation = table(source.table)
        relations.append(relation)
        columns = [v.col.alias(f"s{i}_{j}") for j, (_, v) in enumerate(relation.columns)]
        rowid = [] if relation.rowid is None else [relation.rowid.alias(f"s{i}_r")]
        part = relation.df.select(*columns, (relation.order if ordered else F.lit(0)).alias(f"s{i}_o"), *rowid)
        scope.columns += [(alias, n.lower(), Value(F.col(f"s{i}_{j}"), v.kind, numeric=v.numeric, name=f"s{i}_{j}")) for j, (n, v) in enumerate(relation.columns)]
        scope.shown += [n for n, _ in relation.columns]
        scope.rowids.append((alias, Value(F.col(f"s{i}_r"), "integer", name=f"s{i}_r") if rowid else None))
        if not i:
            df = part
            continue
        on = None if source.on is None else V.truth(value(source.on, scope))
        if source.kind == "LEFT":
            df = df.join(part, F.lit(True) if on is None else on, "left")
        else:
            df = df.crossJoin(part) if on is None else df.join(part, on)
    return df, relations


def _expanded(tree: X.Select, scope: _Scope) -> list[tuple[object, str]]:
    """The items with stars replaced, each with its name. Names in places of stars are those of the tables."""
    out: list[tuple[object, str]] = []
    for item in tree.items:
        if not isinstance(item.expr, X.Star):
            out.append((item.expr, item.alias or X.described(item.expr)))
            continue
        table = item.expr.table and item.expr.table.lower()
        if not any(table in (None, a) for a, _ in scope.rowids):
            raise SchemaError(f"no such table: {item.expr.table}" if table else "no tables for *")
        for (alias, name, _), shown in zip(scope.columns, scope.shown, strict=True):
            if table in (None, alias):
                out.append((X.Name(alias, name), shown))
    return out


def _free(node: object, keys: set) -> list[X.Name]:
    """The names of an expression outside of aggregates and grouping keys."""
    if node in keys or _aggregate(node):
        return []
    return [node] if isinstance(node, X.Name) else [n for x in X.parts(node) for n in _free(x, keys)]


def _grouped(df: DataFrame, tree: X.Select, calls: list[X.Call], said: list, scope: _Scope, order: Column) -> tuple[DataFrame, _Scope, Column]:
    """One row per group, with the scope of what may be said of it: aggregates, grouping keys, and the columns of its first row."""
    for call in calls:
        if any(_aggregates(a) for a in call.args):
            raise SchemaError(f"misuse of aggregate function {call.name}()")
    keys = [value(k, scope).plain for k in tree.group_by]
    made = [V.aggregate(c.name, [value(a, scope) for a in c.args], c.distinct, c.star, order) for c in calls]
    aggregates = [v.col.alias(f"a{i}") for i, v in enumerate(made)]
    # Other columns are those of the group's first row.
    fields = []
    for name in dict.fromkeys(n for node in said for n in _free(node, set(tree.group_by))):
        try:
            fields.append(scope.find(name).name)
        except SchemaError:
            continue  # An alias of ORDER BY, or an error where it is looked up.
    first = [F.min_by(F.struct(*dict.fromkeys(fields)), order).alias("first")] if fields else []
    first.append((F.min(order) if tree.group_by else F.first(F.lit(0))).alias("o"))
    grouped = df.groupBy(*[k.col.alias(f"g{i}") for i, k in enumerate(keys)]).agg(*aggregates, *first)
    at = lambda v, col: Value(col, v.kind, numeric=v.numeric, name=v.name)
    known = {c: at(v, F.col(f"a{i}")) for i, (c, v) in enumerate(zip(calls, made, strict=True))}
    known |= {node: at(k, F.col(f"g{i}")) for i, (node, k) in enumerate(zip(tree.group_by, keys, strict=True))}
    inner = _Scope(params=scope.params, known=known, shown=scope.shown)
    by_key = {scope.find(node).name: known[node] for node in tree.group_by if isinstance(node, X.Name)}
    placed = lambda v: by_key.get(v.name) or at(v, F.col("first")[v.name])
    inner.columns = [(a, n, placed(v)) for a, n, v in scope.columns]
    inner.rowids = [(a, v and placed(v)) for a, v in scope.rowids]
    return grouped, inner, F.col("o")


def _order_key(expr: object, items: list, outputs: list[Value], scope: _Scope) -> tuple[object, Value, int | None]:
    """What ORDER BY names: an ordinal, a selected expression, a unique source column, then an alias; with the place among the outputs."""
    at = None
    if isinstance(expr, X.Literal) and isinstance(expr.value, int):
        if not 1 <= expr.value <= len(outputs):
            raise SchemaError(f"ORDER BY position {expr.value} is not in the select list")
        at = expr.value - 1
    else:
        at = next((i for i, (e, _) in enumerate(items) if e == expr), None)
    if at is None and isinstance(expr, X.Name) and expr.table is None:
        try:
            scope.find(expr)
        except SchemaError:
            at = next((i for i, (_, name) in enumerate(items) if name.lower() == expr.name.lower()), None)
            if at is None:
                raise
    return (expr, value(expr, scope).plain, None) if at is None else (items[at][0], outputs[at], at)


def _number(node: object, spark: SparkSession, params: Sequence) -> int | None:
    """A constant of LIMIT or OFFSET; None for NULL."""
    if node is None:
        return None
    found = constant(node, spark, params)
    if found is not None and not isinstance(found, int | float):
        raise QuernError("LIMIT and OFFSET take numbers")
    return None if found is None else int(found)


def constant(node: object, spark: SparkSession, params: Sequence) -> object:
    """The Python value of an expression without columns."""
    match node:
        case X.Literal(x):
            return x
        case X.Param(i) if i < len(params):
            return int(params[i]) if isinstance(params[i], bool) else params[i]
        case X.Unary("-", X.Literal(int() | float() as x)):
            return -x
    v = value(node, _Scope(params=params)).plain
    return V.shown(spark.range(1).select(v.col.alias("v")).first()["v"])


# EXPLAIN.


def _conjuncts(node: object) -> list:
    if isinstance(node, X.Binary) and node.op == "AND":
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [] if node is None else [node]


def _lines(tree: X.Select, relations: list[Relation], scope: _Scope) -> list[str]:
    """How the layout of each source can serve the statement, one line a step."""
    if not relations:
        return ["SCAN CONSTANT ROW"]
    where, out = _conjuncts(tree.where), []
    for i, (source, relation) in enumerate(zip(tree.sources, relations, strict=True)):
        tests = where if not i else _conjuncts(source.on) + ([] if source.kind == "LEFT" else where)
        out.append(f"{'SCAN' if not i else f'{source.kind} JOIN'} {source.table} {_path(source.alias.lower(), relation, tests)}")
    if tree.group_by:
        out.append("GROUP BY (hash)")
    elif any(_aggregates(i.expr) for i in tree.items):
        out.append("AGGREGATE (single group)")
    out += ["DISTINCT (hash)"] * tree.distinct + ["ORDER BY (sort)"] * bool(tree.order_by) + ["LIMIT"] * (tree.limit is not None)
    return out


def _path(alias: str, relation: Relation, tests: list) -> str:
    own = {n.lower() for n, _ in relation.columns} | {"rowid"}
    equal, ranged = set(), set()
    for test in tests:
        match test:
            case X.Binary(op, a, b) if op in X.COMPARISONS and op not in ("!=", "<>"):
                for x in (a, b):
                    if isinstance(x, X.Name) and (x.table or alias).lower() == alias and x.name.lower() in own:
                        (equal if op in ("=", "==") else ranged).add(x.name.lower())
            case X.Between(X.Name(table, name), _, _, False) if (table or alias).lower() == alias and name.lower() in own:
                ranged.add(name.lower())
    if "rowid" in equal:
        return "USING ROWID (rowid=?)"
    best: tuple = ()
    for index in relation.indexes:
        bound = 0
        while bound < len(index.columns) and index.columns[bound].lower() in equal:
            bound += 1
        if bound:
            best = max(best, (bound, index.unique and bound == len(index.columns), index.name, ", ".join(f"{c}=?" for c in index.columns[:bound])))
    if best:
        return f"USING INDEX {best[2]} ({best[3]})"
    for index in relation.indexes:
        if index.columns[0].lower() in ranged:
            return f"USING INDEX {index.name} ({index.columns[0]} range)"
    return "(full table scan)"


def row_scope(alias: str, relation: Relation, params: Sequence) -> _Scope:
    """The scope of one table's own rows, for UPDATE and DELETE."""
    alias = alias.lower()
    return _Scope([(alias, n.lower(), v) for n, v in relation.columns], [(alias, Value(relation.rowid, "integer"))], [n for n, _ in relation.columns], params)
