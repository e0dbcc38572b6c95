"""Logarithms, power and quantile transforms, binning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.base import Estimator, InPlace, Model, chosen, doubles, no_collision, non_empty, replaced
from quern.errors import Computation, InvalidInput
from quern.functions.exprs import EPSILON, INF, NAN, finite, flog, is_finite, null_guard, num, q
from quern.functions.stats import RANGE, column_stats, quantiles

GOLDEN = (math.sqrt(5) - 1) / 2


class Log(InPlace):
    invertible = True

    def __init__(self, columns, base):
        super().__init__(columns)
        self.base = base

    def expr(self, name):
        return flog(q(name), self.base)

    def inverse(self, name):
        x = q(name)
        if self.base == "e":
            return F.exp(x)
        return F.expm1(x) if self.base == "1p" else F.pow(num(float(self.base)), x)


class LogTransformer(Estimator):
    """``ln``, ``log1p`` (default), ``log2``, ``log10`` or a base as a number.

    With ``check_positive`` a fit rejects values outside the domain; a transform never checks: log of zero is -Inf, of a
    negative number NaN.
    """

    BASES = {"ln": "e", "log1p": "1p", "log2": "2", "log10": "10"}

    def __init__(self, columns: list[str] | None = None, method: str | float = "log1p", check_positive: bool = True):
        self.columns, self.method, self.check_positive = columns, method, check_positive

    def _fit(self, df, target=None):
        base = self.BASES.get(self.method) if isinstance(self.method, str) else float(self.method)
        if base is None or isinstance(base, float) and not (math.isfinite(base) and base > 0 and base != 1):
            raise InvalidInput(f"bad logarithm '{self.method}'")
        cols = chosen(df, self.columns, T.DoubleType)
        non_empty(df)
        floor = -1.0 if base == "1p" else 0.0
        stats = column_stats(df, cols, {"n": F.count, "bad": lambda x: F.sum(F.when(x <= floor, 1).otherwise(0))})
        for c in cols:
            if not stats[c]["n"]:
                raise Computation(f"column '{c}' has no usable value")
            if self.check_positive and stats[c]["bad"]:
                shown = [r[0] for r in df.where(finite(q(c)) <= floor).select(q(c)).limit(5).collect()]
                raise InvalidInput(f"column '{c}' has {stats[c]['bad']} values not above {floor:g}, such as {shown}")
        return Log(cols, str(base) if isinstance(base, str) else base)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, num(0))) if abs(lam) < 1e-10 else (F.pow(F.greatest(x, num(0)) + 1.0, num(lam)) - 1.0) / num(lam)
    below = num(1) - F.least(x, num(0))
    down = -F.log(below) if abs(2 - lam) < 1e-10 else -(F.pow(below, num(2 - lam)) - 1.0) / num(2 - lam)
    return F.when(x.isNull() | F.isnan(x), x).when(x >= 0, up).otherwise(down)


def _yj(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-10 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log(1 - x[~pos]) if abs(2 - lam) < 1e-10 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def likelihood_lambdas(df: DataFrame, cols: list[str], method: str, steps: int = 100) -> dict[str, float]:
    """Each column's most likely exponent by golden section on [-5, 5], all columns at once.

    Jobs are distributed aggregates over the value counts of all columns, which are computed once; each serves every
    bracket that the next four steps may reach. Nothing but two moments a column and candidate reaches the driver, so
    the number of rows does not matter. Narrowing stops early when every bracket is under 1e-9.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), finite(q(c)).alias("x")) for i, c in enumerate(cols)])).alias("s")).select("s.*")
    values = stacked.where("x is not null").groupBy("i", "x").agg(F.count("*").alias("w")).persist()
    try:
        log_term = F.log(F.col("x")) if method == "box-cox" else F.when(F.col("x") >= 0, F.log1p(F.abs("x"))).otherwise(-F.log1p(F.abs("x")))
        term = {r.i: (r.n, r.t) for r in values.groupBy("i").agg(F.sum("w").alias("n"), F.sum(F.col("w") * log_term).alias("t")).collect()}

        def scores(at: dict[int, list[float]]) -> dict[int, dict[float, float]]:
            rows = ",".join(f"({i}, {k}, CAST('{v!r}' AS DOUBLE))" for i, many in at.items() for k, v in enumerate(many))
            table = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(i, k, lam)")
            x, lam = F.col("x"), F.col("lam")
            if method == "box-cox":
                t = F.when(F.abs(lam) < 1e-10, F.log(x)).otherwise((F.pow(x, lam) - 1.0) / F.when(F.abs(lam) < 1e-10, num(1)).otherwise(lam))
            else:
                two = num(2) - lam
                up = F.when(F.abs(lam) < 1e-10, F.log1p(F.greatest(x, num(0)))).otherwise((F.pow(F.greatest(x, num(0)) + 1.0, lam) - 1.0) / F.when(F.abs(lam) < 1e-10, num(1)).otherwise(lam))
                base = num(1) - F.least(x, num(0))
                down = F.when(F.abs(two) < 1e-10, -F.log(base)).otherwise(-(F.pow(base, two) - 1.0) / F.when(F.abs(two) < 1e-10, num(1)).otherwise(two))
                t = F.when(x >= 0, up).otherwise(down)
            mapped = values.join(F.broadcast(table), "i").withColumn("t", t)
            w = F.col("w").cast("double")
            sums = mapped.groupBy("i", "k").agg(F.sum(w).alias("n"), F.sum(w * F.col("t")).alias("s"), F.sum(w * F.col("t") * F.col("t")).alias("ss"))
            out = {i: dict.fromkeys(many, -INF) for i, many in at.items()}
            for r in sums.collect():
                if r.s is None or not math.isfinite(r.s) or not math.isfinite(r.ss):
                    continue
                var = r.ss / r.n - (r.s / r.n) ** 2
                if var > 0:
                    lam_k = at[r.i][r.k]
                    out[r.i][lam_k] = -r.n / 2 * math.log(var) + (lam_k - 1) * term[r.i][1]
            return out

        def inner(a: float, b: float) -> tuple[float, float]:
            return b - GOLDEN * (b - a), a + GOLDEN * (b - a)

        def reach(a: float, b: float, depth: int) -> set[float]:
            c, d = inner(a, b)
            return {c, d} | (reach(a, d, depth - 1) | reach(c, b, depth - 1) if depth > 1 else set())

        span = {i: (-5.0, 5.0) for i in term}
        for _ in range(0, steps, 4):
            got = scores({i: sorted(reach(a, b, 4)) for i, (a, b) in span.items()})
            for i, (a, b) in span.items():
                for _ in range(4):
                    c, d = inner(a, b)
                    a, b = (a, d) if got[i][c] > got[i][d] else (c, b)
                span[i] = (a, b)
            if all(b - a < 1e-9 for a, b in span.values()):
                break
        return {cols[i]: (a + b) / 2 for i, (a, b) in span.items()}
    finally:
        values.unpersist()


class Power(InPlace):
    invertible = True

    def __init__(self, params: dict[str, tuple[float, float, float]], method: str):
        super().__init__(list(params))
        self.params, self.method = params, method

    def raw(self, name):
        x, lam = q(name), self.params[name][0]
        if self.method == "yeo-johnson":
            return yeo_johnson(x, lam)
        bad = F.raise_error(F.lit(f"InvalidInput: column '{name}' has a value that is not positive")).cast("double")
        y = F.log(x) if abs(lam) < 1e-10 else (F.pow(x, num(lam)) - 1.0) / num(lam)
        return F.when(x.isNull() | F.isnan(x), x).when(x > 0, y).otherwise(bad)

    def expr(self, name):
        _, mean, std = self.params[name]
        return (self.raw(name) - num(mean)) / num(std)

    def inverse(self, name):
        lam, mean, std = self.params[name]
        y = q(name) * num(std) + num(mean)

        def root(base: Column, power: float) -> Column:
            bad = F.raise_error(F.lit(f"InvalidInput: column '{name}' is outside the range of the transform")).cast("double")
            return F.when(base > 0, F.pow(base, num(power))).otherwise(bad)

        if self.method == "box-cox":
            x = F.exp(y) if abs(lam) < 1e-10 else root(y * num(lam) + 1.0, 1 / lam)
            return F.when(y.isNull() | F.isnan(y), y).otherwise(x)
        up = F.expm1(y) if abs(lam) < 1e-10 else root(y * num(lam) + 1.0, 1 / lam) - 1.0
        down = -F.expm1(-y) if abs(2 - lam) < 1e-10 else num(1) - root(num(1) - y * num(2 - lam), 1 / (2 - lam))
        return F.when(y.isNull() | F.isnan(y), y).when(y >= 0, up).otherwise(down)


class PowerTransformer(Estimator):
    """Yeo-Johnson or Box-Cox with the most likely exponent, then (``standardize``) to mean 0, deviation 1."""

    def __init__(self, method: str = "yeo-johnson", standardize: bool = True):
        if method not in ("yeo-johnson", "box-cox"):
            raise InvalidInput(f"unknown method '{method}'")
        self.method, self.standardize = method, standardize

    def _fit(self, df, target=None):
        non_empty(df)
        return self.fit_columns(df, doubles(df))

    def fit_columns(self, df, cols):
        stats = column_stats(df, cols, RANGE)
        for c in cols:
            if not stats[c]["n"]:
                raise Computation(f"column '{c}' has no usable value")
            if self.method == "box-cox" and stats[c]["min"] <= 0:
                raise InvalidInput(f"column '{c}' has values that are not positive")
        lam = likelihood_lambdas(df, cols, self.method)
        params = {c: (lam[c], 0.0, 1.0) for c in cols}
        if self.standardize:
            raw = Power(params, self.method)
            moved = df.select(*[F.when(is_finite(q(c)), raw.raw(c)).alias(c) for c in cols])
            got = column_stats(moved, cols, {"mean": F.avg, "std": F.stddev_pop})
            for c in cols:
                mean, std = got[c]["mean"], got[c]["std"]
                if mean is None or not math.isfinite(mean) or not math.isfinite(std) or std < EPSILON:
                    raise Computation(f"column '{c}' has no spread after the transform")
                params[c] = (lam[c], mean, std)
        return Power(params, self.method)


class Quantile(InPlace):
    """Rank among the grid by a vectorised binary search; ``normal`` passes ranks through the probit."""

    invertible = True

    def __init__(self, grids: dict[str, list[float]], normal: bool):
        super().__init__(list(grids))
        self.grids, self.normal = grids, normal

    def expr(self, name):
        grid, normal = np.array(self.grids[name]), self.normal

        @F.pandas_udf("double")
        def rank(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(quantile_rank(x.to_numpy(float), grid, normal))

        return F.when(is_finite(q(name)) | (F.abs(q(name)) == INF), rank(q(name))).otherwise(q(name))

    def inverse(self, name):
        grid, normal = np.array(self.grids[name]), self.normal

        @F.pandas_udf("double")
        def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from statistics import NormalDist

            cdf = NormalDist().cdf
            for x in batches:
                r = x.to_numpy(float)
                r = np.array([cdf(v) if v == v else v for v in r]) if normal else np.clip(r, 0, 1)
                yield pd.Series(np.where(np.isnan(r), np.nan, np.interp(r * (len(grid) - 1), np.arange(len(grid)), grid)))

        return null_guard(q(name), value(q(name)))


def quantile_rank(x: np.ndarray, grid: np.ndarray, normal: bool) -> np.ndarray:
    """Rank in [0, 1] by linear interpolation; a value equal to several grid points takes the first, a constant grid 0.5."""
    n = len(grid)
    if n == 1 or grid[0] == grid[-1]:
        r = np.full(len(x), 0.5)
    else:
        at = np.clip(np.searchsorted(grid, x, "left"), 1, n - 1)
        lo, hi = grid[at - 1], grid[at]
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(x == hi, at, at - 1 + (x - lo) / np.where(hi > lo, hi - lo, 1)) / (n - 1)
        r = np.where(x <= grid[0], 0.0, np.where(x >= grid[-1], 1.0, r))
    if normal:
        from statistics import NormalDist

        inv = NormalDist().inv_cdf
        r = np.array([inv(min(max(v, 1e-15), 1 - 1e-15)) if v == v else v for v in r])
    return np.where(np.isnan(x), np.nan, r)


class QuantileTransformer(Estimator):
    """To a uniform or normal distribution by the ranks of up to ``n_quantiles`` grid values."""

    def __init__(self, n_quantiles: int = 1000, output_distribution: str = "uniform"):
        self.n_quantiles, self.output_distribution = n_quantiles, output_distribution

    def _fit(self, df, target=None):
        if self.n_quantiles < 1:
            raise InvalidInput("n_quantiles must be at least 1")
        if self.output_distribution not in ("uniform", "normal"):
            raise InvalidInput(f"unknown distribution '{self.output_distribution}'")
        cols = doubles(df)
        height = df.count()
        if not height:
            raise InvalidInput("the frame has no rows")
        n = min(self.n_quantiles, height)
        grids = quantiles(df, cols, [i / (n - 1) if n > 1 else 0.5 for i in range(n)])
        for c in cols:
            if grids[c] is None:
                raise Computation(f"column '{c}' has no usable value")
        return Quantile(grids, self.output_distribution == "normal")


def lloyd(values: list[tuple[float, int]], k: int, rounds: int = 100) -> list[float]:
    """Bin edges of deterministic 1-D k-means over (value, count) pairs in ascending order."""
    x = [v for v, _ in values]
    if len(x) <= k:
        centers = x
    else:
        centers = [x[i * (len(x) - 1) // (k - 1)] for i in range(k)] if k > 1 else [x[0]]
        xs, ws = np.array(x), np.array([w for _, w in values], float)
        owner = None
        for _ in range(rounds):
            c = np.array(centers)
            near = np.abs(xs[:, None] - c[None, :]).argmin(1)
            if owner is not None and (near == owner).all():
                break
            owner = near
            weight = np.bincount(near, ws, len(c))
            total = np.bincount(near, ws * xs, len(c))
            centers = [t / w if w else v for t, w, v in zip(total, weight, centers, strict=True)]
    centers = sorted({float(c) for c in centers})
    return [x[0], *((a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)), x[-1]]


_DRIVER_VALUES = 50_000  # distinct values up to which k-means runs on the driver


def kmeans_edges(df: DataFrame, name: str, k: int, rounds: int = 100, most: int = _DRIVER_VALUES) -> list[float]:
    """The same bins for any number of distinct values: beyond ``most`` every round is one aggregate over them."""
    counts = df.select(finite(q(name)).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("w")).repartitionByRange("x")
    counts = counts.withColumn("p", F.spark_partition_id()).persist()
    try:
        per = {r.p: r for r in counts.groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        n = sum(r.n for r in per.values())
        if n <= max(most, k):
            return lloyd(sorted((r.x, r.w) for r in counts.select("x", "w").toLocalIterator()), k, rounds)
        wanted, seen = [], 0  # of the first centers: partition and place there
        for p in sorted(per):
            wanted += [(p, i * (n - 1) // (k - 1) - seen + 1) for i in range(k) if seen <= i * (n - 1) // (k - 1) < seen + per[p].n] if k > 1 else []
            seen += per[p].n
        place = F.row_number().over(Window.partitionBy("p").orderBy("x"))
        hit = F.lit(False)
        for p, i in wanted:
            hit = hit | ((F.col("p") == p) & (F.col("i") == i))
        centers = sorted(r.x for r in counts.withColumn("i", place).where(hit).collect())
        low, high = min(r.lo for r in per.values()), max(r.hi for r in per.values())
        for _ in range(rounds):
            gaps = F.array(*[F.abs(F.col("x") - F.lit(c)) for c in centers])
            sums = {r.o: r for r in counts.groupBy(F.array_position(gaps, F.array_min(gaps)).alias("o")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("t")).collect()}
            new = [sums[i + 1].t / sums[i + 1].w if i + 1 in sums else c for i, c in enumerate(centers)]
            moved, centers = max(abs(a - b) for a, b in zip(new, centers, strict=True)), new
            if moved <= 1e-12 * max(abs(low), abs(high)):
                break
        centers = sorted(set(centers))
        return [low, *((a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)), high]
    finally:
        counts.unpersist()


class Bins(Model):
    def __init__(self, edges: dict[str, list[float]], encode: str):
        self.edges, self.encode = edges, encode

    def required(self):
        return [(c, T.DoubleType) for c in self.edges]

    def effective_bins(self, name: str) -> int:
        return max(1, len(self.edges[name]) - 1)

    def index(self, name: str) -> Column:
        inner = self.edges[name][1:-1]
        x = q(name)
        return F.size(F.filter(F.array(*[num(e) for e in inner]), lambda e: e <= x)) if inner else F.lit(0)

    def outputs(self, schema):
        new = {}
        for c in self.edges:
            at, x = self.index(c), q(c)
            if self.encode == "ordinal":
                new[c] = [(c, F.when(x.isNull(), None).when(~is_finite(x), num(NAN)).otherwise(at.cast("double")))]
            else:
                first = 1 if self.encode == "onehot-drop-first" else 0
                new[c] = [(f"{c}_bin_{j}", F.when(is_finite(x) & (at == j), 1.0).otherwise(0.0)) for j in range(first, self.effective_bins(c))]
        return replaced(schema, new)


class KBinsDiscretizer(Estimator):
    """``uniform``, ``quantile`` or ``kmeans`` bins as ``ordinal`` numbers or one-hot columns ``{c}_bin_{j}``."""

    def __init__(self, n_bins: int = 5, strategy: str = "quantile", encode: str = "ordinal"):
        self.n_bins, self.strategy, self.encode = n_bins, strategy, encode

    def _fit(self, df, target=None):
        if self.n_bins < 2:
            raise InvalidInput("n_bins must be at least 2")
        if self.strategy not in ("uniform", "quantile", "kmeans") or self.encode not in ("ordinal", "onehot", "onehot-drop-first"):
            raise InvalidInput("unknown strategy or encoding")
        non_empty(df)
        cols = doubles(df)
        span = column_stats(df, cols, RANGE)
        for c in cols:
            if not span[c]["n"]:
                raise Computation(f"column '{c}' has no usable value")
        k, edges = self.n_bins, {}
        if self.strategy == "quantile":
            edges = quantiles(df, cols, [i / k for i in range(k + 1)])
        for c in cols:
            lo, hi = span[c]["min"], span[c]["max"]
            if self.strategy == "uniform":
                edges[c] = [lo + (hi - lo) * i / k for i in range(k)] + [hi]
            elif self.strategy == "kmeans":
                edges[c] = kmeans_edges(df, c, k)
            edges[c] = sorted(set(edges[c]))
        model = Bins(edges, self.encode)
        if self.encode == "onehot-drop-first":
            for c in cols:
                if model.effective_bins(c) < 2:
                    raise InvalidInput(f"column '{c}' has a single bin; dropping the first leaves none")
        no_collision([n for n, _ in model.outputs(df.schema)])
        return model
