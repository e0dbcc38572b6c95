"""Imputation, missingness and column removal."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, InPlace, Model, Select, appended, doubles, no_collision, non_empty
from quern.errors import Computation, InvalidInput
from quern.functions.exprs import not_nan, num, q
from quern.functions.stats import column_stats, quantiles


class Fill(InPlace):
    def __init__(self, fills: dict[str, float]):
        super().__init__(list(fills))
        self.fills = fills

    def expr(self, name):
        return F.when(q(name).isNull() | F.isnan(q(name)), num(self.fills[name])).otherwise(q(name))


def modes(df, cols) -> dict[str, float | None]:
    """Most frequent non-missing value; ties go to the smallest bit pattern (non-negative before negative, then by size)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), not_nan(q(c)).alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.max(F.struct("n", (F.col("v") >= 0).alias("plus"), (-F.abs("v")).alias("near"), F.col("v").alias("v"))).alias("b"))
    out: dict[str, float | None] = dict.fromkeys(cols)
    for r in best.collect():
        out[cols[r.i]] = r.b.v
    return out


def fill_values(df, cols, strategy: str) -> dict[str, float | None]:
    if strategy == "mean":
        return {c: s["m"] for c, s in column_stats(df, cols, {"m": F.avg}, not_nan).items()}
    if strategy == "median":
        return {c: g and g[0] for c, g in quantiles(df, cols, [0.5], not_nan).items()}
    return modes(df, cols)


class SimpleImputer(Estimator):
    """``mean``, ``median``, ``most_frequent`` or a constant, for double columns with missing values (null or NaN) at fit."""

    def __init__(self, strategy: str | float = "mean"):
        if isinstance(strategy, str) and strategy not in ("mean", "median", "most_frequent"):
            raise InvalidInput(f"unknown strategy '{strategy}'")
        self.strategy = strategy

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        row = df.agg(*[F.sum(F.when(q(c).isNull() | F.isnan(q(c)), 1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        need = [c for i, c in enumerate(cols) if row[f"m{i}"]]
        if not isinstance(self.strategy, str):
            return Fill(dict.fromkeys(need, float(self.strategy)))
        fills = fill_values(df, need, self.strategy)
        for c in need:
            if fills[c] is None:
                raise Computation(f"column '{c}' has no value to learn from")
        return Fill(fills)


class Flags(Model):
    def __init__(self, columns):
        self.columns = columns

    def required(self):
        return [(c, None) for c in self.columns]

    def outputs(self, schema):
        return appended(schema, [(f"{c}_missing", F.when(q(c).isNull(), 1.0).otherwise(0.0)) for c in self.columns])


class MissingIndicator(Estimator):
    """``{c}_missing`` is 1 where the column is null (NaN is not missing here). ``columns=None``: all."""

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def _fit(self, df, target=None):
        cols = df.columns if self.columns is None else self.columns
        if not cols:
            raise InvalidInput("no columns")
        for c in cols:
            if c not in df.columns:
                raise InvalidInput(f"column '{c}' is missing")
        model = Flags(list(cols))
        no_collision([f"{c}_missing" for c in cols], df.columns)
        return model


class ConstantColumnRemover(Estimator):
    """Drops columns with at most one distinct value; with ``ignore_nulls=False`` a column with any null stays, an all-null one too."""

    def __init__(self, ignore_nulls: bool = True):
        self.ignore_nulls = ignore_nulls

    def _fit(self, df, target=None):
        non_empty(df)
        kept = [c for c in df.columns if c not in self.constants(df)]
        if not kept:
            raise InvalidInput("every column is constant")
        return Select(kept)

    def constants(self, df) -> set[str]:
        """min == max decides; no column needs its distinct values shuffled."""
        aggs = []
        for i, f in enumerate(df.schema.fields):
            c = q(f.name)
            key = F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType,)) else c
            key = F.when(c.isNotNull(), key)
            aggs += [F.min(key).eqNullSafe(F.max(key)).alias(f"c{i}"), F.max(c.isNull()).alias(f"n{i}")]
        row = df.agg(*aggs).first()
        same = set()
        for i, c in enumerate(df.columns):
            if row[f"c{i}"] and (self.ignore_nulls or not row[f"n{i}"]):
                same.add(c)
        return same


class DuplicateColumnRemover(Estimator):
    """Drops columns equal to an earlier one of the same type; unless ``consider_nulls``, a null equals anything."""

    def __init__(self, consider_nulls: bool = False):
        self.consider_nulls = consider_nulls

    def _fit(self, df, target=None):
        non_empty(df)
        twins = self.duplicates(df)
        return Select([c for c in df.columns if c not in twins])

    def duplicates(self, df) -> dict[str, str]:
        """{column: the earlier one it equals}"""
        fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType,))]
        pairs = [(a.name, b.name) for j, b in enumerate(fields) for a in fields[:j] if a.dataType == b.dataType]
        if not pairs:
            return {}

        def same(a, b):
            x, y = q(a), q(b)
            return x.eqNullSafe(y) if self.consider_nulls else F.coalesce(x == y, F.lit(True))

        row = df.agg(*[F.min(same(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        out: dict[str, str] = {}
        for i, (a, b) in enumerate(pairs):
            if row[f"p{i}"] and b not in out:
                out[b] = a
        return out


class VarianceThreshold(Estimator):
    """Keeps double columns whose population variance over finite values is at least ``threshold``; nothing else survives."""

    def __init__(self, threshold: float = 0.0):
        self.threshold = threshold

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        stats = column_stats(df, cols, {"v": F.var_pop})
        kept = [c for c in cols if stats[c]["v"] is not None and math.isfinite(stats[c]["v"]) and stats[c]["v"] >= self.threshold]
        if not kept:
            raise InvalidInput("no column reaches the variance threshold")
        return Select(kept, [(c, stats[c]["v"]) for c in kept])
