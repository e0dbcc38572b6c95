"""Supervised and unsupervised feature selection."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.base import Estimator, Select, doubles, non_empty
from quern.errors import InvalidInput
from quern.functions.exprs import finite, num, q
from quern.functions.neighbours import Held, ball, below, count_within, digamma, neighbour_distances

#: (frame, feature columns, target) -> one score per column; the extension point of the selectors.
ScoreFunction = Callable[[DataFrame, list[str], str], list[tuple[str, float]]]


def f_classif(df: DataFrame, cols: list[str], target: str) -> list[tuple[str, float]]:
    """One-way ANOVA F of each column over the classes of the target; pairs with a null are left out.

    Class sums are one shuffle of (column, class) partial moments. A perfect separator scores infinity.
    """
    y = q(target)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(c).alias("x")) for i, c in enumerate(cols)])
    rows = df.where(y.isNotNull()).select(y.alias("y"), F.explode(pairs).alias("p")).where("p.x is not null")
    stats: dict[int, list] = {i: [] for i in range(len(cols))}
    for r in rows.groupBy("p.i", "y").agg(F.count("*").alias("n"), F.avg("p.x").alias("m"), F.var_pop("p.x").alias("v")).collect():
        stats[r.i].append((r.n, r.m, r.v))
    out = []
    for i, c in enumerate(cols):
        groups = stats[i]
        n = sum(g[0] for g in groups)
        if len(groups) < 2:
            raise InvalidInput(f"column '{c}' meets fewer than two classes")
        mean = math.fsum(g[0] * g[1] for g in groups) / n
        between = math.fsum(g[0] * (g[1] - mean) ** 2 for g in groups)
        within = math.fsum(g[0] * g[2] for g in groups)
        if not math.isfinite(between):
            raise InvalidInput(f"the deviations of column '{c}' are not finite")
        if n <= len(groups):
            score = 0.0
        elif within == 0:
            score = math.inf if between > 0 else 0.0
        else:
            score = between / (len(groups) - 1) / (within / (n - len(groups)))
        out.append((c, score))
    return out


def f_regression(df: DataFrame, cols: list[str], target: str) -> list[tuple[str, float]]:
    """F of each column's linear fit to a double target: r^2 / (1 - r^2) * (n - 2), from centred moments."""
    if not isinstance(df.schema[target].dataType, T.DoubleType):
        raise InvalidInput(f"the target '{target}' is not double")
    y, aggs = q(target), []
    for i, c in enumerate(cols):
        both = q(c).isNotNull() & y.isNotNull()
        x, t = F.when(both, q(c)), F.when(both, y)
        aggs += [F.count(x).alias(f"n{i}"), F.var_pop(x).alias(f"x{i}"), F.var_pop(t).alias(f"y{i}"), F.covar_pop(x, t).alias(f"c{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n, vx, vy, cov = (row[f"{k}{i}"] for k in "nxyc")
        if n < 3 or not vx or not vy:
            score = 0.0
        else:
            r2 = cov / vx * (cov / vy)
            score = math.inf if r2 >= 1 else r2 / (1 - r2) * (n - 2)
        out.append((c, score))
    return out


def _order(scores: list[tuple[str, float]], by_name: bool, nan_first: bool) -> list[tuple[str, float]]:
    def rank(s):
        nan = math.isnan(s[1])
        return ((not nan) if nan_first else nan, 0.0 if nan else -s[1], s[0] if by_name else "")

    return sorted(scores, key=rank)


class SelectKBest(Estimator):
    """The k columns with the largest scores, in score order (a NaN score ranks first)."""

    supervised = True

    def __init__(self, k: int, score_func: ScoreFunction = f_classif):
        self.k, self.score_func = k, score_func

    def _fit(self, df, target):
        if self.k < 1:
            raise InvalidInput("k must be at least 1")
        scores = self.score_func(df, doubles(df, target), target)
        return Select([c for c, _ in _order(scores, False, True)[: self.k]], scores)


class SelectPercentile(Estimator):
    """The best ``percentile`` percent of the columns, rounded up and at least one; ties by name, NaN last."""

    supervised = True

    def __init__(self, percentile: float = 10.0, score_func: ScoreFunction = f_classif):
        self.percentile, self.score_func = percentile, score_func

    def _fit(self, df, target):
        if not 0 < self.percentile <= 100:
            raise InvalidInput("the percentile must lie in (0, 100]")
        non_empty(df)
        cols = doubles(df, target)
        scores = self.score_func(df, cols, target)
        n = max(1, math.ceil(self.percentile / 100 * len(cols)))
        return Select([c for c, _ in _order(scores, True, False)[:n]], scores)


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Pearson correlation over the rows where both columns are finite.

    One aggregate counts the finite values; pairs of columns without gaps then need only their covariance and each
    column's variance, the others variances over their common rows.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: f"v{i}" for i, c in enumerate(names)}
    clean = df.select(*[finite(q(c)).alias(at[c]) for c in names])
    first = clean.agg(F.count("*").alias("all"), *[f(at[c]).alias(f"{k}{at[c]}") for c in names for k, f in (("n", F.count), ("s", F.var_pop))]).first()
    gaps = {c for c in names if first[f"n{at[c]}"] < first["all"]}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(at[a]), F.col(at[b])
        aggs.append(F.covar_pop(x, y).alias(f"c{i}"))
        if a in gaps or b in gaps:
            both = x.isNotNull() & y.isNotNull()
            aggs += [F.count_if(both).alias(f"n{i}"), F.var_pop(F.when(both, x)).alias(f"x{i}"), F.var_pop(F.when(both, y)).alias(f"y{i}")]
    row = clean.agg(*aggs).first().asDict()
    out = {}
    for i, (a, b) in enumerate(pairs):
        whole = (first["all"], first[f"s{at[a]}"], first[f"s{at[b]}"])
        n, vx, vy = (row.get(f"{k}{i}", w) for k, w in zip("nxy", whole, strict=True))
        out[a, b] = snapped(n, vx, vy, row[f"c{i}"])
    return out


def snapped(n, vx, vy, cov) -> float:
    if n < 2 or not vx or not vy:
        return 0.0
    r = cov / math.sqrt(vx) / math.sqrt(vy)
    return math.copysign(1.0, r) if abs(abs(r) - 1) <= 1e-12 else min(1.0, max(-1.0, r))


def average_ranks(df: DataFrame, name: str, out: str, hold: Held, *aggs) -> DataFrame:
    """Each distinct ``__v`` of a double column with its number ``__n``, its average rank ``out`` and ``aggs`` over its rows.

    There is no global window: distinct values are counted and range-partitioned; one running sum per partition and the
    partitions' totals (as many numbers as partitions) give every value its rank.
    """
    counts = df.groupBy(q(name).alias("__v")).agg(F.count("*").alias("__n"), *aggs).repartitionByRange("__v")
    counts = hold(counts.withColumn("__p", F.spark_partition_id()))
    totals = {r["__p"]: r["t"] for r in counts.groupBy("__p").agg(F.sum("__n").alias("t")).collect()}
    before, seen = {}, 0
    for p in sorted(totals):
        before[p], seen = seen, seen + totals[p]
    start = F.create_map(*[F.lit(int(x)) for kv in (before or {0: 0}).items() for x in kv])
    w = Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.element_at(start, F.col("__p")) + F.sum("__n").over(w)
    return counts.withColumn(out, upto - (F.col("__n") - 1) / 2.0).drop("__p")


def _ranked_pairs(rows: DataFrame, pairs: list[tuple[str, str]], distinct: dict[str, int], hold: Held) -> dict[tuple[str, str], float]:
    """Spearman correlations of columns without gaps.

    Columns with few values come first: their ranks, less the mean rank, join the rows (broadcast if small). The column
    with most values is never joined: its pairs need only the other columns' sums of ranks for each of its values, which
    one aggregate counts along with the values. The variances come from the counts of the values.
    """
    cols = sorted({c for p in pairs for c in p}, key=lambda c: (distinct[c], c))
    n = rows.count()
    mean, var, cov = (n + 1) / 2.0, {}, {}
    moments = lambda t, *more: t.agg(F.sum(F.col("__n") * F.col("__r") * F.col("__r")).alias("s"), *more).first()
    for c in cols[:-1]:
        ranks = average_ranks(rows.select(c), c, "__k", hold).withColumn("__r", F.col("__k") - mean)
        var[c] = moments(ranks)["s"]
        rows = rows.join(ranks.select(F.col("__v"), F.col("__r").alias(f"r{c}")), q(c) == F.col("__v")).drop("__v", c)
    last = cols[-1]
    inner = [(a, b) for a, b in pairs if last not in (a, b)]
    sums = [F.sum(f"r{c}").alias(f"r{c}") for c in cols[:-1]] + [F.sum(F.col(f"r{a}") * F.col(f"r{b}")).alias(f"p{i}") for i, (a, b) in enumerate(inner)]
    ranks = average_ranks(rows, last, "__k", hold, *sums).withColumn("__r", F.col("__k") - mean)
    row = moments(ranks, *[F.sum(F.col("__r") * F.col(f"r{c}")).alias(f"r{c}") for c in cols[:-1]], *[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(inner))])
    var[last] = row["s"]
    cov = {p: row[f"p{i}"] for i, p in enumerate(inner)}
    cov |= {(a, b): row[f"r{b if a == last else a}"] for a, b in pairs if last in (a, b)}
    return {(a, b): snapped(n, var[a] / n, var[b] / n, cov[a, b] / n) if n > 1 else 0.0 for a, b in pairs}


def rank_correlations(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Spearman correlation over the rows where both columns are finite.

    Columns without gaps are ranked once each and correlated together; a pair with a gap has rows of its own, and so ranks
    of its own.
    """
    clean = df.select(*[finite(q(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    row = clean.agg(F.count("*").alias("all"), *[f(f"v{i}").alias(f"{k}{i}") for i in range(len(cols)) for k, f in (("n", F.count), ("d", F.approx_count_distinct))]).first()
    at = {c: f"v{i}" for i, c in enumerate(cols)}
    distinct = {v: row[f"d{v[1:]}"] for v in at.values()}
    whole = {c for c in cols if row[f"n{at[c][1:]}"] == row["all"]}
    both = [(a, b) for a, b in pairs if a in whole and b in whole]
    out: dict[tuple[str, str], float] = {}
    with Held() as hold:
        for group in ([both] if both else []) + [[p] for p in pairs if p not in set(both)]:
            names = list(dict.fromkeys(at[c] for p in group for c in p))
            rows = clean.select(*names).dropna()
            found = _ranked_pairs(rows, [(at[a], at[b]) for a, b in group], distinct, hold)
            out.update({(a, b): found[at[a], at[b]] for a, b in group})
    return out


class CorrelationThreshold(Estimator):
    """Keeps columns in order, dropping each whose correlation with a kept one reaches the threshold in magnitude."""

    def __init__(self, threshold: float = 0.9, method: str = "pearson"):
        if method not in ("pearson", "spearman"):
            raise InvalidInput(f"unknown method '{method}'")
        self.threshold, self.method = threshold, method

    def _fit(self, df, target=None):
        if not 0 <= self.threshold <= 1:
            raise InvalidInput("the threshold must lie in [0, 1]")
        non_empty(df)
        cols = doubles(df)
        pairs = list(combinations(cols, 2))
        if not pairs:
            return Select(cols)
        if self.method == "pearson":
            r = pair_correlations(df, pairs)
        else:
            r = rank_correlations(df, cols, pairs)
        kept: list[str] = []
        for c in cols:
            if not any(abs(r[k, c]) >= self.threshold for k in kept):
                kept.append(c)
        return Select(kept)


def _unit_points(df: DataFrame, cols: list[str], target: str) -> tuple[DataFrame, dict[int, int]]:
    """Distinct pairs ``i``, ``x``, ``y`` of each column and the target, both finite and scaled to [0, 1], with their
    number ``w``, and ``t``, the target as it is; and the number of rows of each column."""

    def stacked(scale) -> DataFrame:
        pairs = []
        for i, c in enumerate(cols):
            x, y = finite(q(c)), finite(q(target))
            sx, sy = scale(i, x, y)
            pairs.append(F.struct(F.lit(i).alias("i"), (sx + 0.0).alias("x"), (sy + 0.0).alias("y"), (y + 0.0).alias("t"), (x.isNotNull() & y.isNotNull()).alias("ok")))
        return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("ok").drop("ok")

    ends = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    spans = {r.i: r for r in stacked(lambda i, x, y: (x, y)).groupBy("i").agg(F.count("*").alias("n"), *ends).collect()}

    def unit(v, lo: float, hi: float):
        return (v - num(lo)) / num(hi - lo) if hi > lo else num(0)

    def scaled(i, x, y):
        r = spans.get(i)
        return (x, y) if r is None else (unit(x, r.lox, r.hix), unit(y, r.loy, r.hiy))

    return stacked(scaled).groupBy("i", "x", "y", "t").agg(F.count("*").alias("w")), {i: r.n for i, r in spans.items()}


def mutual_classes(df: DataFrame, cols: list[str], target: str, k: int, hold: Held) -> dict[str, float]:
    """Ross's estimator for a class target: the k-th neighbour of the same class, then all values in that radius."""
    points, rows = _unit_points(df, cols, target)
    points = hold(points.select("i", F.col("i").cast("string").alias("c"), F.col("x").alias("v"), F.concat_ws(":", "i", "t").alias("g"), "w"))
    sizes = points.groupBy("g").agg(F.sum("w").alias("size")).where("size > 1")
    asked = hold(points.join(sizes, "g").withColumns({"a": F.col("v"), "b": F.col("v"), "kk": F.least(F.lit(max(k, 1)), F.col("size") - 1).cast("int")}))
    near = neighbour_distances(asked, max(k, 1), hold).select("g", F.col("a").alias("v"), "r")
    near = hold(asked.select("g", "v", "c", "w", "kk", "size").join(near, ["g", "v"]).withColumn("r", below("r")))
    found = count_within(points.select(F.col("c").alias("g"), "v", "w"), ball(near.select(F.col("c").alias("g"), "v", "r", "w", "kk", "size"), "v", "r"), "m", hold)
    sums = found.groupBy("g").agg(F.sum("w").alias("n"), F.sum(F.col("w") * (digamma(F.col("kk")) - digamma(F.col("size")) - digamma(F.col("m")))).alias("s"))
    got = {int(r.g): max(0.0, r.psi + r.s / r.n) for r in sums.withColumn("psi", digamma(F.col("n"))).collect()}
    return {c: got.get(i, 0.0) if rows.get(i, 0) > 1 else 0.0 for i, c in enumerate(cols)}


def mutual_numbers(df: DataFrame, cols: list[str], target: str, k: int, hold: Held) -> dict[str, float]:
    """The first estimator of Kraskov, Stoegbauer and Grassberger: the k-th neighbour of the pair in the maximum norm,
    then the values of each coordinate that are strictly nearer."""
    points, rows = _unit_points(df, cols, target)
    many = F.element_at(F.create_map(*[F.lit(x) for kv in (rows or {-1: 0}).items() for x in kv]), F.col("i"))
    points = hold(points.where(many > 1).select(F.col("i").cast("string").alias("g"), F.col("x").alias("a"), F.col("y").alias("b"), "w", F.least(F.lit(max(k, 1)), many - 1).cast("int").alias("kk")))
    near = hold(neighbour_distances(points, max(k, 1), hold))
    total: dict[str, float] = {}
    for axis in "ab":
        own = points.select("g", F.col(axis).alias("v"), "w")
        asked = near.groupBy("g", F.col(axis).alias("v"), "r").agg(F.sum("w").alias("w")).withColumns({"zero": F.col("r") == 0, "r": below("r")})
        found = count_within(own, ball(asked, "v", "r"), "m", hold)
        n = F.when(F.col("zero"), 1).otherwise(F.col("m"))
        for r in found.groupBy("g").agg(F.sum(F.col("w") * digamma(n)).alias("s")).collect():
            total[r.g] = total.get(r.g, 0.0) + r.s
    psi = lambda m: float(near.sparkSession.range(1).select(digamma(F.lit(m))).first()[0])
    return {c: max(0.0, psi(min(max(k, 1), rows[i] - 1)) + psi(rows[i]) - total[str(i)] / rows[i]) if str(i) in total else 0.0 for i, c in enumerate(cols)}


class MutualInformationSelector(Estimator):
    """The k columns with most mutual information with a double target (``classification`` or ``regression``), ties by name.

    Nearest-neighbour estimates over all rows where both are finite, exact at any size: see ``neighbour_distances`` and
    ``count_within``. Equal pairs travel as one row with their number.
    """

    supervised = True

    def __init__(self, k: int = 10, task: str = "classification", n_neighbors: int = 3):
        if task not in ("classification", "regression"):
            raise InvalidInput(f"unknown task '{task}'")
        self.k, self.task, self.n_neighbors = k, task, n_neighbors

    def _fit(self, df, target):
        if self.k < 1:
            raise InvalidInput("k must be at least 1")
        if not isinstance(df.schema[target].dataType, T.DoubleType):
            raise InvalidInput(f"the target '{target}' is not double")
        cols = doubles(df, target)
        non_empty(df)
        estimate = mutual_classes if self.task == "classification" else mutual_numbers
        with Held() as hold:
            scores = list(estimate(df, cols, target, self.n_neighbors, hold).items())
        return Select([c for c, _ in _order(scores, True, False)[: self.k]], scores)
