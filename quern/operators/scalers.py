"""Scalers and clippers: one aggregate to learn, one projection to apply."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, InPlace, Model, chosen, doubles, in_place, non_empty
from quern.errors import Computation, InvalidInput
from quern.functions.exprs import EPSILON, INF, NAN, clamp, finite, not_nan, num, q
from quern.functions.stats import MOMENTS, column_stats, quantiles


class Affine(InPlace):
    """(x - shift) / scale, then + offset."""

    invertible = True

    def __init__(self, params: dict[str, tuple[float, float, float]]):
        super().__init__(list(params))
        self.params = params

    def expr(self, name):
        shift, scale, offset = self.params[name]
        return (q(name) - num(shift)) / num(scale) + num(offset)

    def inverse(self, name):
        shift, scale, offset = self.params[name]
        return (q(name) - num(offset)) * num(scale) + num(shift)


def _usable(name: str, *values) -> None:
    if any(v is None for v in values):
        raise Computation(f"column '{name}' has no usable value")
    if not all(math.isfinite(v) for v in values):
        raise InvalidInput(f"the statistics of column '{name}' are not finite")


class StandardScaler(Estimator):
    """Zero mean and unit population deviation, over finite values."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std = with_mean, with_std

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        stats = column_stats(df, cols, MOMENTS)
        params = {}
        for c in cols:
            mean, var = stats[c]["mean"], stats[c]["var"]
            _usable(c, mean, var)
            std = math.sqrt(var)
            if self.with_std and std < EPSILON:
                raise Computation(f"column '{c}' has no spread")
            params[c] = (mean if self.with_mean else 0.0, std if self.with_std else 1.0, 0.0)
        return Affine(params)


class MinMaxScaler(Estimator):
    """To ``feature_range``; infinities count, NaN does not."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        self.feature_range = feature_range

    def _fit(self, df, target=None):
        lo, hi = map(float, self.feature_range)
        if not (math.isfinite(lo) and math.isfinite(hi) and lo < hi):
            raise InvalidInput("feature_range must be finite and ascending")
        non_empty(df)
        cols = doubles(df)
        stats = column_stats(df, cols, {"min": F.min, "max": F.max}, not_nan)
        params = {}
        for c in cols:
            a, b = stats[c]["min"], stats[c]["max"]
            if a is None:
                raise Computation(f"column '{c}' has no usable value")
            if b - a < EPSILON:
                raise Computation(f"column '{c}' has no spread")
            if not math.isfinite(b - a):
                raise InvalidInput(f"the range of column '{c}' is not finite")
            params[c] = (a, (b - a) / (hi - lo), lo)
        return Affine(params)


class RobustScaler(Estimator):
    """Median and interquartile range of the finite values."""

    def __init__(self, with_centering: bool = True, with_scaling: bool = True):
        self.with_centering, self.with_scaling = with_centering, with_scaling

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        got = quantiles(df, cols, [0.25, 0.5, 0.75])
        params = {}
        for c in cols:
            if got[c] is None:
                raise Computation(f"column '{c}' has no usable value")
            low, mid, high = got[c]
            if not math.isfinite(high - low):
                raise InvalidInput(f"the range of column '{c}' is not finite")
            if self.with_scaling and high - low < EPSILON:
                raise Computation(f"column '{c}' has no interquartile range")
            params[c] = (mid if self.with_centering else 0.0, high - low if self.with_scaling else 1.0, 0.0)
        return Affine(params)


class MaxAbsScaler(Estimator):
    """By the largest magnitude; columns of zeros pass."""

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        stats = column_stats(df, cols, {"max": lambda x: F.max(F.abs(x))})
        for c in cols:
            if stats[c]["max"] is None:
                raise Computation(f"column '{c}' has no usable value")
        return Affine({c: (0.0, stats[c]["max"] or 1.0, 0.0) for c in cols})


class Clip(InPlace):
    def __init__(self, bounds: dict[str, tuple[float, float]]):
        super().__init__(list(bounds))
        self.bounds = bounds

    def expr(self, name):
        lo, hi = self.bounds[name]
        return q(name) if (lo, hi) == (-INF, INF) else clamp(q(name), lo, hi)


class Winsorizer(Estimator):
    """Clamp to two quantiles of the finite values."""

    def __init__(self, columns: list[str] | None = None, quantiles: tuple[float, float] = (0.05, 0.95)):
        self.columns, self.quantiles = columns, quantiles

    def _fit(self, df, target=None):
        lo, hi = self.quantiles
        if not (math.isfinite(lo) and math.isfinite(hi) and 0 <= lo < hi <= 1):
            raise InvalidInput("quantiles must satisfy 0 <= lo < hi <= 1")
        cols = chosen(df, self.columns, T.DoubleType)
        non_empty(df)
        got = quantiles(df, cols, [lo, hi])
        for c in cols:
            if got[c] is None:
                raise Computation(f"column '{c}' has no usable value")
        return Clip({c: tuple(got[c]) for c in cols})


@dataclass(frozen=True)
class ClipMethod:
    """``iqr``, ``zscore`` or ``mad`` fences at ``k`` spreads."""

    rule: str = "iqr"
    k: float = 1.5


class OutlierClipper(Estimator):
    """Clamp to fences; a column without a usable spread passes."""

    def __init__(self, columns: list[str] | None = None, method: ClipMethod = ClipMethod()):
        self.columns, self.method = columns, method

    def _fit(self, df, target=None):
        k = self.method.k
        if not math.isfinite(k) or k <= 0:
            raise InvalidInput("k must be finite and positive")
        cols = chosen(df, self.columns, T.DoubleType)
        non_empty(df)
        fences = fences_of(df, cols, self.method.rule, k)
        out = {}
        for c in cols:
            if fences[c] is None:
                raise Computation(f"column '{c}' has no usable value")
            lo, hi = fences[c]
            out[c] = (-INF, INF) if math.isnan(lo) or math.isnan(hi) or lo == hi else (lo, hi)
        return Clip(out)


def fences_of(df, cols, rule: str, k: float) -> dict[str, tuple[float, float] | None]:
    """Lower and upper fence per column; None for a column without finite values."""
    if rule == "iqr":
        got = quantiles(df, cols, [0.25, 0.75])
        return {c: g and (g[0] - k * (g[1] - g[0]), g[1] + k * (g[1] - g[0])) for c, g in got.items()}
    if rule == "zscore":
        got = column_stats(df, cols, MOMENTS)
        return {c: (s["mean"] - k * math.sqrt(s["var"]), s["mean"] + k * math.sqrt(s["var"])) if s["n"] else None for c, s in got.items()}
    if rule == "mad":
        mid = {c: g and g[0] for c, g in quantiles(df, cols, [0.5]).items()}
        spread = mads(df, mid)
        return {c: None if mid[c] is None else (mid[c] - k * spread[c], mid[c] + k * spread[c]) for c in cols}
    raise InvalidInput(f"unknown clipping rule '{rule}'")


def mads(df, mid: dict[str, float | None]) -> dict[str, float]:
    """1.4826 times the median absolute deviation."""
    known = [c for c in mid if mid[c] is not None]
    away = df.select(*[F.abs(finite(q(c)) - num(mid[c])).alias(c) for c in known])
    got = quantiles(away, known, [0.5])
    return {c: 1.4826 * got[c][0] if got[c] else NAN for c in known}


class RowNorm(Model):
    def __init__(self, columns, norm):
        self.columns, self.norm = columns, norm

    def required(self):
        return [(c, T.DoubleType) for c in self.columns]

    def outputs(self, schema):
        for f in schema.fields:
            if not isinstance(f.dataType, T.DoubleType):
                raise InvalidInput(f"column '{f.name}' is {f.dataType.simpleString()}; every column must be double")
        parts = [F.coalesce(not_nan(F.abs(q(c))), num(0)) for c in self.columns]
        if self.norm == "max":
            size = F.greatest(*parts) if len(parts) > 1 else parts[0]
        elif self.norm == "l1":
            size = sum(parts[1:], parts[0])
        else:
            peak = F.greatest(*parts) if len(parts) > 1 else parts[0]
            by = F.when((peak > 0) & (peak < INF), peak).otherwise(num(1))
            size = F.sqrt(sum((p / by * (p / by) for p in parts[1:]), parts[0] / by * (parts[0] / by))) * by
        size = F.when(size < INF, size).otherwise(F.raise_error(F.lit("InvalidInput: the norm of a row is not finite")).cast("double"))
        by = F.when(size == 0, num(1)).otherwise(size)
        return in_place(schema, {c: q(c) / by for c in self.columns})


class Normalizer(Estimator):
    """Each row to norm 1 (``l1``, ``l2``, ``max``); nulls and NaN are left out of the norm and stay."""

    def __init__(self, norm: str = "l2"):
        if norm not in ("l1", "l2", "max"):
            raise InvalidInput(f"unknown norm '{norm}'")
        self.norm = norm

    def _fit(self, df, target=None):
        non_empty(df)
        for f in df.schema.fields:
            if not isinstance(f.dataType, T.DoubleType):
                raise InvalidInput(f"column '{f.name}' is {f.dataType.simpleString()}; every column must be double")
        return RowNorm(df.columns, self.norm)


class Threshold(Model):
    def __init__(self, threshold):
        self.threshold = threshold

    def outputs(self, schema):
        cols = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
        if not cols:
            raise InvalidInput("no double column to binarize")
        one = {c: F.when(q(c).isNull() | F.isnan(q(c)), None).when(q(c) > num(self.threshold), 1.0).otherwise(0.0) for c in cols}
        return in_place(schema, one)


class Binarizer(Estimator):
    """1 above the threshold, else 0; null and NaN give null. All double columns of the frame at hand."""

    def __init__(self, threshold: float = 0.0):
        self.threshold = threshold

    def _fit(self, df, target=None):
        if not math.isfinite(self.threshold):
            raise InvalidInput("the threshold must be finite")
        doubles(df)
        return Threshold(self.threshold)
