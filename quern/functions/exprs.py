"""Column helpers that settle what nulls, NaN and infinities mean, whatever the session's ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
INF = float("inf")
NAN = float("nan")


def q(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(x: float) -> Column:
    return F.lit(float(x))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def finite(c: Column) -> Column:
    """The value if finite, else null."""
    return F.when(is_finite(c), c)


def not_nan(c: Column) -> Column:
    """The value if not NaN, else null."""
    return F.when(~F.isnan(c), c)


def null_guard(c: Column, value: Column) -> Column:
    return F.when(c.isNotNull(), value)


def fdiv(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity of the right sign, 0/0 and NaN/0 are NaN; null stays null."""
    negative_zero = b.cast("string") == "-0.0"
    at_zero = F.when((a == 0) | F.isnan(a), num(NAN)).when((a > 0) != negative_zero, num(INF)).otherwise(num(-INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NaN and null pass."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, num(lo)), num(hi)))


def flog(x: Column, base: str | float = "e") -> Column:
    """IEEE logarithm (``e``, ``1p``, 2, 10 or any base): log(0) is -Inf, of a negative number NaN; null stays null."""
    arg = x + 1.0 if base == "1p" else x
    core = {"e": F.log, "1p": F.log1p, "2": F.log2, "10": F.log10}
    value = core[str(base)](x) if str(base) in core else F.log(x) / math.log(float(base))
    sign = -1.0 if str(base) not in core and 0 < float(base) < 1 else 1.0
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x) | (arg < 0), num(NAN))
        .when(arg == 0, num(-INF * sign))
        .when(x == INF, num(INF * sign))
        .otherwise(value)
    )


def signed_zero_free(c: Column) -> Column:
    return c + 0.0


def product(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out
