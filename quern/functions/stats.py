"""Statistics of many columns in one aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.exprs import finite, q

Mask = Callable[[Column], Column]

#: Up to so many rows one exact ``percentile`` aggregate holds the distinct values of a column; beyond, ranks are
#: narrowed down over histograms, exact as well.
SMALL = 5_000_000
BINS = 4096


def column_stats(df: DataFrame, columns: Iterable[str], wanted: dict[str, Callable[[Column], Column]], mask: Mask = finite) -> dict[str, dict]:
    """One job: ``{column: {stat: value}}`` with every stat computed over the masked column."""
    columns = list(columns)
    aggs = [f(mask(q(c))).alias(f"s{i}_{k}") for i, c in enumerate(columns) for k, f in enumerate(wanted.values())]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {c: {name: row[f"s{i}_{k}"] for k, name in enumerate(wanted)} for i, c in enumerate(columns)}


MOMENTS = {"n": F.count, "mean": F.avg, "var": F.var_pop}
RANGE = {"n": F.count, "min": F.min, "max": F.max}


def quantiles(df: DataFrame, columns: Iterable[str], probs: list[float], mask: Mask = finite, small: int | None = None) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation at p * (n - 1); None for a column without values."""
    columns = list(columns)
    if not columns or not probs:
        return dict.fromkeys(columns)
    first = column_stats(df, columns, RANGE, mask)
    limit = SMALL if small is None else small
    out: dict[str, list[float] | None] = {c: None for c in columns if not first[c]["n"]}
    little = [c for c in columns if 0 < first[c]["n"] <= limit]
    got = column_stats(df, little, {"p": lambda x: F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))}, mask)
    out |= {c: [float(v) for v in got[c]["p"]] for c in little}
    for c in columns:
        if c not in out:
            out[c] = _narrowed(df.select(mask(q(c)).alias("x")).where("x is not null"), first[c], probs, limit)
    return out


def _narrowed(values: DataFrame, span: dict, probs: list[float], limit: int) -> list[float]:
    n = span["n"]
    ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    at: dict[int, float] = {}
    todo = [(float(span["min"]), float(span["max"]), 0, n, ranks)]
    while todo:
        lo, hi, below, count, want = todo.pop()
        inside = values.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if lo == hi:
            at |= dict.fromkeys(want, lo)
        elif count <= limit:
            seen = below
            for r in inside.groupBy("x").agg(F.count("*").alias("k")).orderBy("x").toLocalIterator():
                while want and want[0] < seen + r.k:
                    at[want.pop(0)] = r.x
                seen += r.k
        else:
            width = hi / BINS - lo / BINS
            part = F.least(F.greatest(F.floor((F.col("x") - lo) / width), F.lit(0)), F.lit(BINS - 1))
            bins = inside.groupBy(part.alias("b")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
            seen = below
            for b in bins:
                mine = [r for r in want if seen <= r < seen + b.k]
                if mine:
                    todo.append((b.lo, b.hi, seen, b.k, mine))
                seen += b.k
    out = []
    for p in probs:
        k = p * (n - 1)
        a, b = at[math.floor(k)], at[math.ceil(k)]
        out.append(a + (b - a) * (k - math.floor(k)))
    return out
