"""Random numbers that are a function of a seed and counters, so that neither partitions nor their order change them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A draw has 60 bits: 15 hex digits of an MD5.
BITS = 60


def draw(seed: int, *counters: Column | int | str) -> Column:
    """A whole number from 0 to 2^60 - 1. Counters are told apart by their place and may be columns."""
    parts = [F.lit(str(seed)), *(c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in counters)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def below(n: Column | int, seed: int, *counters: Column | int | str) -> Column:
    """A whole number from 0 to n - 1."""
    return draw(seed, *counters) % (n if isinstance(n, Column) else F.lit(n))


def draw_sql(seed: int, *counters: str) -> str:
    """The same draw in DuckDB SQL, for oracles; ``counters`` are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}'", *(f"({c})::VARCHAR" for c in counters)])
    return f"('0x' || left(md5({text}), {BITS // 4}))::BIGINT"


#: Of numbers below this, the logarithm of the factorial is looked up; from it on, Stirling's series is exact to the last digits.
SMALL = 16


def log_factorial(k: Column) -> Column:
    """ln k! of a whole number."""
    table = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(SMALL)))
    z = (k + 1).cast("double")
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return F.when(k < SMALL, F.get(table, F.least(k, F.lit(SMALL - 1)).cast("int"))).otherwise(series)
