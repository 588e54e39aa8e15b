import math
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from quern.functions import semantics as S


def exact(x, digits):
    if x is None or not math.isfinite(x):
        return x
    with localcontext() as ctx:
        ctx.prec = 800
        return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def test_round_half_away_is_exact(spark):
    rng = random.Random(3)
    values = [None, 0.0, 65.205, 2.675, 1.005, 0.125, 2.5, -2.5, -65.205, 1e19, -1e19, 1e300, 2.0**52, 2.0**53 + 2, math.inf, -math.inf, 5e-324, 0.49999999999999994]
    values += [k / 1000 for k in range(20_000)]
    values += [s * round(rng.uniform(0, 10.0 ** rng.randrange(-6, 9)), rng.randrange(8)) for s in (1, -1) for _ in range(2000)]
    # Exact ties, and ties' neighbours.
    values += [v for k in range(500) for t in [(2 * k + 1) / 2, (2 * k + 1) / 8, k + 0.005] for v in (t, -t, math.nextafter(t, 0), math.nextafter(t, math.inf))]
    # Products from 2^51 to 2^54.
    values += [52016846170.885445, *(rng.uniform(2.0**51, 2.0**54) / 10**d for d in (1, 2, 3, 5) for _ in range(1000))]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 5):
        found = {r.x: r.y for r in rows.select("x", S.round_half_away(F.col("x"), digits).alias("y")).collect()}
        wrong = [(v, found[v], exact(v, digits)) for v in values if found[v] != exact(v, digits)]
        assert not wrong, (digits, len(wrong), wrong[:5])
    nan = rows.select(S.round_half_away(F.lit(math.nan), 2).alias("y")).first().y
    assert math.isnan(nan)
    assert rows.select(S.round_half_away(F.lit(2.5), -3).alias("y")).first().y == 3.0
