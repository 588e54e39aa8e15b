"""Column expressions for the dialect where Spark's own functions answer differently.

NULL in, NULL out unless said otherwise. Booleans are Spark booleans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncated toward zero; NULL for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f names it."""
    return F.transform(F.array(x), f)[0]


def _shortest(x: Column) -> Column:
    """A positive real with the fewest digits that read back, as d.ddde+dd."""
    full = F.format_string("%.16e", x)
    # Rounding a decimal text again can go astray by one, so that the cut one is tried as well.
    forms = [F.format_string("%.14e", x), F.format_string("%.15e", x), F.regexp_replace(full, "[0-9]e", "e")]
    return F.coalesce(*[F.when(f.cast("double") == x, f) for f in forms], full)


def _spelled(d: Column) -> Column:
    """The text of digits (without zeros at the end), decimal exponent and exponent part."""
    digits, e, part = d["digits"], d["e"], d["part"]
    rest = F.substring(digits, F.lit(2), F.length(digits))
    plain = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    wide = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), part)
    return F.when(e.between(0, 15), plain).when(e.between(-4, -1), small).otherwise(wide)


def _real_text(x: Column) -> Column:
    def taken_apart(kept: Column) -> Column:
        digits = F.regexp_replace(F.replace(F.substring_index(kept, "e", 1), F.lit("."), F.lit("")), "0+$", "")
        part = F.substring_index(kept, "e", -1)
        return F.struct(digits.alias("digits"), part.cast("int").alias("e"), part.alias("part"))

    text = _bound(_bound(_bound(F.abs(x), _shortest), taken_apart), _spelled)
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def text_of(x: Column, kind: str) -> Column:
    """A value as text: integral doubles below 1e16 print as integers, others with the fewest digits that read back, and with an exponent below 1e-4 and from 1e16 on."""
    if kind not in ("double", "float"):
        return x.cast("string")
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    whole = F.when((x == F.rint(x)) & (F.abs(x) < 1e16), x.cast("decimal(20,0)").cast("string"))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(odd, whole, _real_text(x)))


def cross_class(a: Column, b: Column, answer: bool) -> Column:
    """A comparison of a number with a text: constant unless an operand is NULL."""
    return F.when(~_any_null(a, b), F.lit(answer))


def least(*columns: Column) -> Column:
    """Scalar MIN: NULL if any argument is."""
    return F.when(~_any_null(*columns), F.least(*columns))


def greatest(*columns: Column) -> Column:
    """Scalar MAX: NULL if any argument is."""
    return F.when(~_any_null(*columns), F.greatest(*columns))


def _halves(v: Column) -> tuple[Column, Column]:
    """A double as the exact sum of two of at most 26 bits (Veltkamp)."""
    t = F.lit(134217729.0) * v
    high = t - (t - v)
    return high, v - high


def round_half_away(x: Column, digits: Column | int = 0) -> Column:
    """The exact binary value rounded half away from zero, as a double, for up to 22 digits; NaN and infinities stay.

    The product with the scale is corrected by its exact error: a tie of the product counts as one only if the true
    product is not below it. From a product of 2^53 on a double lies closer to its rounding than to any other double.
    """
    x = x.cast("double")
    scale = F.lit(10.0 ** max(digits, 0)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)
    m = F.abs(x)
    p = m * scale
    (xh, xl), (bh, bl) = _halves(m), _halves(scale)
    error = ((xh * bh - p) + xh * bl + xl * bh) + xl * bl
    whole = F.floor(p).cast("double")
    # An error of a half is possible from 2^52 on, where products are whole.
    up = F.when(p - whole == 0.5, error >= 0).otherwise((p - whole > 0.5) | (error >= 0.5))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.isnan(x) | (p >= 2.0**53), x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))
