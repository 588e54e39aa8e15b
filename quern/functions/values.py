"""Values of the dialect as Spark columns: a column with its storage class.

Classes are integer (long), real (double), text (string), blob (binary), null, and any: a value whose class is known
only at run time, kept as a struct whose fields in their order give the dialect's total order, numbers before text
before blobs. Numbers of any are compared as doubles. Predicates are Spark booleans of class integer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QuernError, SchemaError, TypeMismatchError

from . import semantics as S

ANY = T.StructType([T.StructField(*f) for f in (("cls", T.ByteType()), ("num", T.DoubleType()), ("txt", T.StringType()), ("bin", T.BinaryType()), ("kind", T.StringType()), ("exact", T.LongType()))])
SPARK = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "null": T.StringType(), "any": ANY}
#: The declared types and the classes they stand for.
DECLARED = {
    "INT": "INTEGER", "INTEGER": "INTEGER", "BIGINT": "INTEGER", "SMALLINT": "INTEGER", "REAL": "REAL", "FLOAT": "REAL", "DOUBLE": "REAL", "NUMERIC": "REAL", "DECIMAL": "REAL",
    "TEXT": "TEXT", "VARCHAR": "TEXT", "CHAR": "TEXT", "STRING": "TEXT", "BLOB": "BLOB", "BYTES": "BLOB", "ANY": "ANY", "": "ANY",
}
_CLASS = {"integer": 1, "real": 1, "text": 2, "blob": 3}
_SPACES = r"^\s+|\s+$"


@dataclass(frozen=True)
class Value:
    """``boolean``: the column is a Spark boolean. ``numeric``: an any that holds numbers only. ``literal``: a constant's Python value, if it is one.
    ``name``: the column of a source, if it is one.
    """

    col: Column
    kind: str
    boolean: bool = False
    numeric: bool = False
    literal: object = None
    name: str = ""

    @property
    def plain(self) -> Value:
        """Without a boolean column."""
        return Value(self.col.cast("long"), "integer") if self.boolean else self

    @property
    def number(self) -> bool:
        return self.kind in ("integer", "real")


def null() -> Value:
    return Value(F.lit(None).cast("string"), "null")


def declared(name: str) -> str:
    """The class of a declared type, upper case."""
    try:
        return DECLARED[name.upper()]
    except KeyError:
        raise TypeMismatchError(f"unknown column type {name!r}") from None


def constant(x: object) -> Value:
    """A Python value as a literal."""
    if x is None:
        return null()
    if isinstance(x, bool | int):
        if not -(1 << 63) <= int(x) < 1 << 63:
            raise QuernError(f"integer out of 64 bits: {x}")
        return Value(F.lit(int(x)).cast("long"), "integer", literal=int(x))
    if isinstance(x, float):
        return Value(F.lit(x), "real", literal=x)
    if isinstance(x, bytes | bytearray | memoryview):
        return Value(F.lit(bytes(x)), "blob", literal=bytes(x))
    if isinstance(x, str):
        return Value(F.lit(x), "text", literal=x)
    raise TypeMismatchError(f"unsupported value {x!r}")


def typed(col: Column, kind: T.DataType) -> Value | None:
    """A column of a Spark table; None if the dialect has no class for its type."""
    match kind:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.BooleanType():
            return Value(col if isinstance(kind, T.LongType) else col.cast("long"), "integer")
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return Value(col if isinstance(kind, T.DoubleType) else col.cast("double"), "real")
        case T.StringType():
            return Value(col, "text")
        case T.BinaryType():
            return Value(col, "blob")
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return Value(col.cast("string"), "text")
    return Value(col, "any") if kind == ANY else None


def boolean(col: Column) -> Value:
    return Value(col, "integer", True)


def _struct(cls: Column | int, num: Column | None = None, txt: Column | None = None, bin_: Column | None = None, kind: Column | str = "integer", exact: Column | None = None) -> Column:
    fields = (cls if isinstance(cls, Column) else F.lit(cls), num, txt, bin_, kind if isinstance(kind, Column) else F.lit(kind), exact)
    return F.struct(*[(F.lit(None) if c is None else c).cast(f.dataType).alias(f.name) for c, f in zip(fields, ANY.fields, strict=True)])


def as_any(v: Value) -> Column:
    """The struct form of a value; null stays null."""
    v = v.plain
    match v.kind:
        case "any":
            return v.col
        case "null":
            return F.lit(None).cast(ANY)
        case "integer":
            made = _struct(1, v.col.cast("double"), kind="integer", exact=v.col)
        case "real":
            made = _struct(1, v.col, kind="real")
        case "text":
            made = _struct(2, txt=v.col, kind="text")
        case _:
            made = _struct(3, bin_=v.col, kind="blob")
    return F.when(v.col.isNotNull(), made)


def _of_numbers(whole: Column, exact: Column, real: Column) -> Value:
    """An integer where ``whole`` holds and a real elsewhere; null where the chosen one is."""
    made = F.when(whole, F.when(exact.isNotNull(), _struct(1, exact.cast("double"), kind="integer", exact=exact))).otherwise(F.when(real.isNotNull(), _struct(1, real, kind="real")))
    return Value(made, "any", numeric=True)


def unified(values: list[Value]) -> list[Value]:
    """The values in one class: their own if they share one, else any."""
    values = [v.plain for v in values]
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        numeric = all(v.numeric for v in values if v.kind != "null")
        return [v if v.kind == kind else Value(F.lit(None).cast(SPARK[kind]), kind, numeric=numeric) for v in values]
    numeric = all(v.number or v.numeric or v.kind == "null" for v in values)
    return [Value(as_any(v), "any", numeric=numeric) for v in values]


# Conversions.


def text(v: Value) -> Column:
    """The text form."""
    v = v.plain
    match v.kind:
        case "integer" | "text" | "null":
            return v.col.cast("string")
        case "blob":
            return v.col.cast("string")
        case "real":
            return S.text_of(v.col, "double")
    x = v.col
    return F.when(x["kind"] == "integer", x["exact"].cast("string")).when(x["kind"] == "real", S.text_of(x["num"], "double")).when(x["kind"] == "text", x["txt"]).otherwise(x["bin"].cast("string"))


def _parsed(s: Column) -> tuple[Column, Column, Column]:
    """Text as a number: (is it whole, the integer, the real); by prefix, then 0, where it is none."""
    s = F.regexp_replace(s, _SPACES, "")
    whole = s.rlike(r"^[+-]?[0-9]+$") & s.try_cast("long").isNotNull()
    real = s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    prefix = F.coalesce(F.nullif(F.regexp_extract(s, r"^[+-]?[0-9]+", 0), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    exact = F.when(s.isNotNull(), F.when(whole, s.try_cast("long")).otherwise(prefix))
    return F.coalesce(whole | ~real, F.lit(True)), exact, F.when(real, s.try_cast("double"))


def num(v: Value) -> Value:
    """The value as a number, for arithmetic: integer, real or a numeric any."""
    v = v.plain
    if v.number or v.numeric:
        return v
    match v.kind:
        case "null":
            return Value(F.lit(None).cast("long"), "integer")
        case "text":
            return _of_numbers(*_parsed(v.col))
        case "blob":
            return Value(F.when(v.col.isNotNull(), F.lit(0).cast("long")), "integer")
    x = v.col
    whole, exact, real = _parsed(x["txt"])
    chosen = F.when(x["kind"] == "integer", x["exact"]).when(x["kind"] == "text", exact).when(x["kind"] == "blob", F.lit(0).cast("long"))
    is_real = (x["kind"] == "real") | ((x["kind"] == "text") & ~whole)
    return _of_numbers(~F.coalesce(is_real, F.lit(False)), chosen, F.coalesce(x["num"], real))


def double(v: Value) -> Column:
    n = num(v)
    return n.col["num"] if n.kind == "any" else n.col.cast("double")


def long(v: Value) -> Column:
    """Truncated to an integer."""
    n = num(v)
    return n.col.cast("long") if n.number else F.coalesce(n.col["exact"], n.col["num"].cast("long"))


def truth(v: Value) -> Column:
    """True, false or unknown."""
    if v.boolean:
        return v.col
    match v.kind:
        case "null":
            return F.lit(None).cast("boolean")
        case "integer" | "real":
            return v.col != 0
        case "blob":
            return F.length(v.col) > 0
        case "text":
            return double(v) != 0
    return F.when(v.col["kind"] == "blob", F.length(v.col["bin"]) > 0).otherwise(double(v) != 0)


def flat(v: Value) -> Column:
    """The value for a plain table: any becomes a double where it holds numbers only, else text."""
    v = v.plain
    return v.col if v.kind != "any" else v.col["num"] if v.numeric else text(v)


def shown(x: object) -> object:
    """A collected value as Python's own."""
    if hasattr(x, "asDict"):
        return {"integer": x.exact, "real": x.num, "text": x.txt, "blob": x.bin and bytes(x.bin)}[x.kind] if x.kind != "blob" else bytes(x.bin)
    return bytes(x) if isinstance(x, bytearray) else x


# Operators.


def key(v: Value) -> Column:
    """What equality and order look at."""
    v = v.plain
    return v.col if v.kind != "any" else F.when(v.col.isNotNull(), F.struct(*[v.col[f] for f in ("cls", "num", "txt", "bin")]))


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a: Value, b: Value) -> Value:
    """A comparison without conversions: any number is below any text, and a text below any blob."""
    op = {"==": "=", "<>": "!="}.get(op, op)
    a, b = a.plain, b.plain
    if "null" in (a.kind, b.kind):
        return boolean(F.lit(None).cast("boolean"))
    if a.kind == b.kind != "any" or a.number and b.number:
        return boolean(_COMPARE[op](a.col, b.col))
    if "any" not in (a.kind, b.kind):
        return boolean(S.cross_class(a.col, b.col, _COMPARE[op](_CLASS[a.kind], _CLASS[b.kind])))
    x, y = key(Value(as_any(a), "any")), key(Value(as_any(b), "any"))
    if op in ("=", "!="):
        same = reduce(lambda p, q: p & q, [x[f].eqNullSafe(y[f]) for f in ("cls", "num", "txt", "bin")])
        found = same if op == "=" else ~same
    else:
        found = _COMPARE[op](x, y)
    return boolean(F.when(a.col.isNotNull() & b.col.isNotNull(), found))


def same(a: Value, b: Value) -> Column:
    """IS: null-safe equality of values of the same storage class."""
    a, b = a.plain, b.plain
    if a.kind == b.kind != "any":
        return a.col.eqNullSafe(b.col)
    if "any" in (a.kind, b.kind):
        x, y = as_any(a), as_any(b)
        fields = [F.coalesce(x[f].eqNullSafe(y[f]), F.lit(False)) for f in ("cls", "num", "txt", "bin", "kind")]
        return reduce(lambda p, q: p & q, fields, x.isNull() == y.isNull())
    return a.col.isNull() & b.col.isNull()


def matches(a: Value, b: Value) -> Column:
    """Equality by value in which null matches null."""
    a, b = a.plain, b.plain
    return F.coalesce(compare("=", a, b).col, a.col.isNull() & b.col.isNull())


_ARITHMETIC = {
    "+": (lambda a, b: a + b,) * 2, "-": (lambda a, b: a - b,) * 2, "*": (lambda a, b: a * b,) * 2,
    "/": (S.int_div, F.try_divide), "%": (F.try_mod, F.try_mod),
}


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Integers stay integers, division truncates; a real on either side makes it real; division by zero is null."""
    whole, real = _ARITHMETIC[op]
    a, b = num(a), num(b)
    if a.kind == b.kind == "integer":
        return Value(whole(a.col, b.col).cast("long"), "integer")
    if "real" in (a.kind, b.kind):
        return Value(real(double(a), double(b)), "real")
    x, y = as_any(a), as_any(b)
    both = (x["kind"] == "integer") & (y["kind"] == "integer")
    return _of_numbers(both, F.when(both, whole(x["exact"], y["exact"])), F.when(~both, real(x["num"], y["num"])))


def negative(v: Value) -> Value:
    n = num(v)
    return Value(-n.col, n.kind) if n.number else _of_numbers(n.col["kind"] == "integer", -n.col["exact"], -n.col["num"])


# Storing.


def stored(v: Value, kind: str) -> tuple[Column, Column]:
    """The value as a column of a declared class, and whether it cannot be stored there."""
    v = v.plain
    never = F.lit(False)
    if v.kind == "null":
        return F.lit(None).cast(SPARK[kind.lower()]), never
    if kind == "ANY":
        return as_any(v), never
    if v.kind == "any":
        cases = [stored(Value(v.col[f], k), kind) for k, f in (("integer", "exact"), ("real", "num"), ("text", "txt"), ("blob", "bin"))]
        col, bad = F.lit(None).cast(SPARK[kind.lower()]), F.lit(False)
        for k, (c, b) in zip(("integer", "real", "text", "blob"), cases, strict=True):
            col, bad = F.when(v.col["kind"] == k, c).otherwise(col), F.when(v.col["kind"] == k, b).otherwise(bad)
        return col, F.coalesce(bad, never)
    x = v.col
    if kind == "INTEGER":
        if v.kind == "integer":
            return x, never
        if v.kind == "real":
            fits = (x == F.floor(x)) & (F.abs(x) < 2.0**63)
            return F.when(fits, x.cast("long")), F.coalesce(~fits, never)
        trimmed = F.regexp_replace(x.cast("string"), _SPACES, "")
        col = F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("long"))
    elif kind == "REAL":
        if v.number:
            return x.cast("double"), never
        trimmed = F.regexp_replace(x.cast("string"), _SPACES, "")
        col = F.when(trimmed.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed.try_cast("double"))
    elif kind == "TEXT":
        return (text(v), never) if v.kind != "blob" else (F.lit(None).cast("string"), x.isNotNull())
    else:
        return (x.cast("binary"), never) if v.kind in ("text", "blob") else (F.lit(None).cast("binary"), x.isNotNull())
    if v.kind == "blob":
        return F.lit(None).cast(SPARK[kind.lower()]), x.isNotNull()
    return col, x.isNotNull() & col.isNull()


# Scalar functions.


def _substr(args: list[Value]) -> Value:
    s, start = text(args[0]), long(args[1])
    n = long(args[2]) if len(args) > 2 else None
    size = F.length(s)
    begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(F.greatest(start - 1, F.lit(0)))
    if n is None:
        first, count = begin, size
    else:
        first = F.when(n < 0, F.greatest(begin + n, F.lit(0))).otherwise(begin)
        count = F.when(n < 0, begin - first).otherwise(F.least(n, size))
    # Places past the end of the text give the empty text; both fit an int once bounded by its size.
    found = F.substring(s, F.least(first, size).cast("int") + 1, count.cast("int"))
    return Value(F.when(start.isNotNull() if n is None else start.isNotNull() & n.isNotNull(), found), "text")


def _length(args: list[Value]) -> Value:
    v = args[0].plain
    if v.kind == "any":
        return Value(F.when(v.col["kind"] == "blob", F.octet_length(v.col["bin"])).otherwise(F.length(text(v))).cast("long"), "integer")
    return Value((F.octet_length(v.col) if v.kind == "blob" else F.length(text(v))).cast("long"), "integer")


def _abs(args: list[Value]) -> Value:
    n = num(args[0])
    return Value(F.abs(n.col), n.kind) if n.number else _of_numbers(n.col["kind"] == "integer", F.abs(n.col["exact"]), F.abs(n.col["num"]))


def _trim(strip):
    return lambda args: Value(strip(text(args[0]), text(args[1])) if len(args) > 1 else strip(text(args[0])), "text")


def _typeof(args: list[Value]) -> Value:
    v = args[0].plain
    name = v.col["kind"] if v.kind == "any" else F.lit(v.kind)
    return Value(F.when(v.col.isNull(), "null").otherwise(name), "text")


def _hex(args: list[Value]) -> Value:
    v = args[0].plain
    if v.kind == "any":
        return Value(F.when(v.col["kind"] == "blob", F.hex(v.col["bin"])).otherwise(F.hex(text(v))), "text")
    return Value(F.hex(v.col if v.kind == "blob" else text(v)), "text")


def _extreme(pick):
    def run(args: list[Value]) -> Value:
        values = unified(args)
        return Value(pick(*[v.col for v in values]), values[0].kind, numeric=values[0].numeric)

    return run


def _coalesce(args: list[Value]) -> Value:
    values = unified(args)
    return Value(F.coalesce(*[v.col for v in values]), values[0].kind, numeric=values[0].numeric)


def _nullif(args: list[Value]) -> Value:
    v = args[0].plain
    return Value(F.when(~F.coalesce(compare("=", *args).col, F.lit(False)), v.col), v.kind, numeric=v.numeric)


def _round(args: list[Value]) -> Value:
    digits = F.greatest(long(args[1]), F.lit(0)) if len(args) > 1 else F.lit(0)
    return Value(S.round_half_away(double(args[0]), digits), "real")


#: name -> (least arguments, most, builder).
SCALARS = {
    "ABS": (1, 1, _abs), "LENGTH": (1, 1, _length), "UPPER": (1, 1, lambda a: Value(F.upper(text(a[0])), "text")), "LOWER": (1, 1, lambda a: Value(F.lower(text(a[0])), "text")),
    "SUBSTR": (2, 3, _substr), "SUBSTRING": (2, 3, _substr), "COALESCE": (1, None, _coalesce), "IFNULL": (2, 2, _coalesce), "NULLIF": (2, 2, _nullif), "ROUND": (1, 2, _round),
    "TRIM": (1, 2, _trim(F.trim)), "LTRIM": (1, 2, _trim(F.ltrim)), "RTRIM": (1, 2, _trim(F.rtrim)),
    "REPLACE": (3, 3, lambda a: Value(F.replace(text(a[0]), text(a[1]), text(a[2])), "text")), "INSTR": (2, 2, lambda a: Value(F.call_function("instr", text(a[0]), text(a[1])).cast("long"), "integer")),
    "TYPEOF": (1, 1, _typeof), "HEX": (1, 1, _hex), "MIN": (2, None, _extreme(S.least)), "MAX": (2, None, _extreme(S.greatest)),
}
AGGREGATES = frozenset({"COUNT", "SUM", "TOTAL", "AVG", "MIN", "MAX", "GROUP_CONCAT"})


def scalar(name: str, args: list[Value]) -> Value:
    if name not in SCALARS:
        raise QuernError(f"no such function: {name}")
    least, most, build = SCALARS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise QuernError(f"wrong number of arguments to {name}()")
    return build([a.plain for a in args])


def like(x: Value, pattern: Value) -> Column:
    return F.ilike(text(x), F.replace(text(pattern), F.lit("\\"), F.lit("\\\\")))


# Aggregates.


def aggregate(name: str, args: list[Value], distinct: bool, star: bool, order: Column) -> Value:
    """``order``: a unique key of the rows in scan order."""
    if star:
        if name != "COUNT":
            raise SchemaError(f"{name}(*) has no meaning")
        return Value(F.count(F.lit(1)), "integer")
    if not args or len(args) > (2 if name == "GROUP_CONCAT" else 1) and name != "COUNT":
        raise QuernError(f"wrong number of arguments to {name}()")
    v = args[0].plain
    match name:
        case "COUNT":
            return Value(F.count_distinct(v.col) if distinct else F.count(v.col), "integer")
        case "MIN" | "MAX":
            return Value((F.min if name == "MIN" else F.max)(v.col), v.kind, numeric=v.numeric)
        case "GROUP_CONCAT":
            return _concatenated(v, args[1] if len(args) > 1 else None, distinct, order)
    if distinct and v.kind in ("text", "any") and not v.numeric:
        raise SchemaError(f"{name}(DISTINCT) needs a numeric argument")
    n = num(v)
    add = F.sum_distinct if distinct else F.sum
    if n.number:
        total = add(n.col)
        exact = Value(total, n.kind)
    else:
        whole = F.when(n.col["kind"] == "integer", n.col["exact"])
        real = F.when(n.col["kind"] == "real", n.col["num"])
        ints, reals = add(whole), add(real)
        exact = _of_numbers(reals.isNull(), ints, reals + F.coalesce(ints, F.lit(0)))
        total = F.coalesce(reals + F.coalesce(ints, F.lit(0)), ints.cast("double"))
    if name == "SUM":
        return exact
    if name == "TOTAL":
        return Value(F.coalesce(total.cast("double"), F.lit(0.0)), "real")
    count = F.count_distinct(v.col) if distinct else F.count(v.col)
    return Value(F.try_divide(total.cast("double"), count), "real")


def _concatenated(v: Value, separator: Value | None, distinct: bool, order: Column) -> Value:
    """Texts in scan order, each after the first preceded by its own separator; of equal values the first counts."""
    mark = F.coalesce(text(separator), F.lit("")) if separator else F.lit(",")
    always = "," if separator is None else separator.literal
    held = F.struct(order.alias("o"), v.col.alias("v"), text(v).alias("x"), mark.alias("m"))
    rows = F.array_sort(F.collect_list(F.when(v.col.isNotNull(), held)))
    if distinct and v.kind != "any" and isinstance(always, str):
        return Value(F.when(F.size(rows) > 0, F.array_join(F.array_distinct(F.transform(rows, lambda r: r["x"])), always)), "text")
    if distinct:
        values = F.transform(rows, lambda r: r["v"])
        rows = F.filter(rows, lambda r, i: F.array_position(values, r["v"]) == i + 1)
    pieces = F.transform(rows, lambda r, i: F.when(i == 0, r["x"]).otherwise(F.concat(r["m"], r["x"])))
    return Value(F.when(F.size(rows) > 0, F.array_join(pieces, "")), "text")
