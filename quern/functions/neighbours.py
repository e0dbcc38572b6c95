"""Exact nearest-neighbour distances and range counts over whole tables, by range-partitioned slabs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of one task.
SLAB = 50_000
_BLOCK = 128
_EULER = 0.5772156649015329
_EXACT = 30


class Held:
    """Frames that stay persisted until a fit has read them."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist())
        return df

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *error) -> None:
        for df in self.frames:
            df.unpersist()


def digamma(n: Column) -> Column:
    """At whole numbers from 1: harmonic numbers less Euler's constant, beyond 30 by the asymptotic series."""
    small = F.array(*[F.lit(sum(1 / i for i in range(1, m)) - _EULER) for m in range(1, _EXACT + 1)])
    x = F.greatest(n, F.lit(1)).cast("double")
    far = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * x * x * x * x * x * x)
    return F.when(n <= _EXACT, F.element_at(small, n.cast("int"))).otherwise(far)


def _window(sb: np.ndarray, qb: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    reach = u * (1 + 1e-9) + 1e-300
    return np.searchsorted(sb, qb - reach, "left"), np.searchsorted(sb, qb + reach, "right")


def _bounds(q: np.ndarray, bound: np.ndarray, p: np.ndarray, axis: int, k: int, own: bool):
    """Points and queries in the order of ``axis``, and for each query a distance that k points do not exceed."""
    order, asked = np.argsort(p[axis], kind="stable"), np.argsort(q[axis], kind="stable")
    s, r = p[:, order], q[:, asked]
    at = np.arange(len(order)) if own else np.searchsorted(s[axis], r[axis])
    off = np.arange(-k - 8, k + 9)
    i = at[:, None] + off[None, :]
    out = (i < 0) | (i >= s.shape[1])
    if own:
        out |= off[None, :] == 0
    i = np.clip(i, 0, s.shape[1] - 1)
    d = np.maximum(np.abs(s[0][i] - r[0][:, None]), np.abs(s[1][i] - r[1][:, None]))
    d[out] = np.inf
    u = np.minimum(bound[asked], np.partition(d, k - 1, axis=1)[:, k - 1])
    lo, hi = _window(s[axis], r[axis], u)
    return float((hi - lo).mean()), axis, order, asked, u


def nearest(q: np.ndarray, bound: np.ndarray, p: np.ndarray, w: np.ndarray, k: int, own: bool = False):
    """Distances and weights of the k points nearest to each query in the maximum norm (infinite where there are fewer).

    ``q`` and ``p`` are arrays of two coordinates; points farther than a query's ``bound`` need not be found. With
    ``own`` the queries are the points, and none is its own neighbour. Queries are taken in blocks along the axis that
    leaves fewer points to look at.
    """
    _, axis, order, asked, u = min((_bounds(q, bound, p, axis, k, own) for axis in (0, 1)), key=lambda x: x[0])
    s, sw = p[:, order], w[order]
    dist, weight = np.full((q.shape[1], k), np.inf), np.zeros((q.shape[1], k), np.int64)
    scale = np.floor(np.log2(np.clip(u, 1e-300, 1e300)))
    turn = np.lexsort((q[axis][asked], scale))
    for at in range(0, len(turn), _BLOCK):
        t = turn[at : at + _BLOCK]
        j, reach = asked[t], u[t]
        lo, hi = _window(s[axis], q[axis][j], reach)
        lo, hi = int(lo.min()), int(hi.max())
        if hi <= lo:
            continue
        d = np.maximum(np.abs(s[0, lo:hi] - q[0, j][:, None]), np.abs(s[1, lo:hi] - q[1, j][:, None]))
        if own:
            d[np.arange(len(t)), t - lo] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if hi - lo > k else np.broadcast_to(np.arange(hi - lo), (len(t), hi - lo))
        dist[j, : best.shape[1]] = np.take_along_axis(d, best, 1)
        weight[j, : best.shape[1]] = sw[lo:hi][best]
    return dist, weight


_NEAR = "array<struct<d:double,w:bigint>>"
_NEAR_ARROW = pa.list_(pa.struct([("d", pa.float64()), ("w", pa.int64())]))


def _near_array(dist: np.ndarray, weight: np.ndarray) -> pa.Array:
    keep = np.isfinite(dist)
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(weight[keep])], names=["d", "w"])
    return pa.ListArray.from_arrays(pa.array(ends), values).cast(_NEAR_ARROW)


def neighbour_distances(points: DataFrame, k: int, hold: Held, slab: int | None = None) -> DataFrame:
    """``points`` with ``r``: the maximum-norm distance to the ``kk``-th nearest other point of the same group.

    ``points`` has a string group ``g``, coordinates ``a`` and ``b`` (finite), a weight ``w`` (equal points are one row)
    and ``kk`` (at most ``k`` and at most the group's weight less one). Slabs of about ``slab`` rows (``SLAB``) are cut along
    (g, a, b). Each point finds a bound for its distance in its own slab, then visits the other slabs whose bounding box
    is nearer than that. Only the boxes (slabs and groups in number) reach the driver; the result is exact.
    """
    parts = max(1, math.ceil(points.count() / (slab or SLAB)))
    laid = hold(points.select("g", "a", "b", "w", "kk").repartitionByRange(parts, "g", "a", "b").withColumn("pid", F.spark_partition_id()))
    corner = [f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))]
    boxes: dict[str, list] = {}
    for row in laid.groupBy("g", "pid").agg(*corner).orderBy("g", "pid").collect():
        boxes.setdefault(row.g, []).append((row.pid, row.loa, row.hia, row.lob, row.hib))
    shared = points.sparkSession.sparkContext.broadcast({g: tuple(np.array(x) for x in zip(*b, strict=True)) for g, b in boxes.items() if len(b) > 1})
    shape = f"g string, a double, b double, w bigint, kk int, pid int, near {_NEAR}"

    def coordinates(t: pa.Table) -> np.ndarray:
        return np.stack([t["a"].to_numpy(), t["b"].to_numpy()])

    def first(t: pa.Table) -> pa.Table:
        p = coordinates(t)
        dist, weight = nearest(p, np.full(t.num_rows, np.inf), p, t["w"].to_numpy(), k, own=True)
        return t.select(["g", "a", "b", "w", "kk", "pid"]).append_column("near", _near_array(dist, weight))

    own = laid.groupBy("g", "pid").applyInArrow(first, shape)
    reached = F.aggregate(F.array_sort("near"), F.struct((F.col("w") - 1).alias("n"), F.lit(0.0).alias("d")), lambda s, x: F.when(s["n"] >= F.col("kk"), s).otherwise(F.struct((s["n"] + x["w"]).alias("n"), x["d"].alias("d"))))
    own = hold(own.withColumn("s", reached).withColumn("bound", F.when(F.col("s.n") >= F.col("kk"), F.col("s.d")).otherwise(F.lit(float("inf")))).drop("s"))

    def visits(batches):
        for t in batches:
            g, home, a, b, u = t.column("g").to_pylist(), t.column("pid").to_numpy(), t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("bound").to_numpy()
            rows, goals = [], []
            codes = np.unique(np.array(g, object), return_inverse=True) if g else ([], [])
            for i, name in enumerate(codes[0]):
                if name not in shared.value:
                    continue
                pid, loa, hia, lob, hib = shared.value[name]
                mine = np.flatnonzero(codes[1] == i)
                start = np.searchsorted(hia, a[mine] - u[mine] * (1 + 1e-9), "left")
                stop = np.searchsorted(loa, a[mine] + u[mine] * (1 + 1e-9), "right")
                for step in range(int((stop - start).max(initial=0))):
                    at = start + step
                    on = at < stop
                    m, at = mine[on], at[on]
                    away = np.maximum(np.maximum(loa[at] - a[m], a[m] - hia[at]), np.maximum(lob[at] - b[m], b[m] - hib[at]))
                    go = (away < u[m]) & (pid[at] != home[m])
                    rows.append(m[go]), goals.append(pid[at[go]])
            take = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            goal = np.concatenate(goals) if goals else np.zeros(0, np.int64)
            out = t.take(pa.array(take)).select(["g", "a", "b", "bound"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(goal.astype(np.int32))], names=["g", "a", "b", "bound", "pid"])

    def second(asked: pa.Table, t: pa.Table) -> pa.Table:
        if not asked.num_rows or not t.num_rows:
            near = pa.array([[]] * asked.num_rows, _NEAR_ARROW)
        else:
            near = _near_array(*nearest(coordinates(asked), asked["bound"].to_numpy(), coordinates(t), t["w"].to_numpy(), k))
        return asked.select(["g", "a", "b"]).append_column("near", near)

    calls = own.select("g", "a", "b", "bound", "pid").mapInArrow(visits, "g string, a double, b double, bound double, pid int")
    more = calls.groupBy("g", "pid").cogroup(laid.groupBy("g", "pid")).applyInArrow(second, f"g string, a double, b double, near {_NEAR}")
    both = own.select("g", "a", "b", "w", "kk", "near").unionByName(more, allowMissingColumns=True)
    joined = both.groupBy("g", "a", "b").agg(F.max("w").alias("w"), F.max("kk").alias("kk"), F.flatten(F.collect_list("near")).alias("near"))
    return joined.select("g", "a", "b", "w", "kk", reached["d"].alias("r"))


def below(radius: str) -> Column:
    """The next smaller double of a radius in (0, 1]; 0 stays 0."""

    @F.pandas_udf("double")
    def step(r: pd.Series) -> pd.Series:
        return pd.Series(np.where(r > 0, np.nextafter(r, 0), 0.0))

    return step(radius)


def ball(df: DataFrame, value: str, radius: str) -> DataFrame:
    """``df`` with ``lo`` and ``hi``: the extreme doubles in [0, inf) whose computed distance to ``value`` is <= ``radius``.

    Values and radii are in [0, 1]. The distances themselves decide, as ``value - radius`` may round.
    """

    def ends(v: np.ndarray, r: np.ndarray):
        slack = 2.0**-50
        out = []
        for sign in (-1, 1):
            yes = np.clip(v + sign * np.maximum(r - slack, 0), 0, None) + 0.0
            no = np.clip(v + sign * (r + slack), 0, None) + 0.0
            if sign < 0:
                yes = np.where(v - no <= r, no, yes)
            yes_i, no_i = yes.view(np.int64).copy(), no.view(np.int64).copy()
            while (np.abs(yes_i - no_i) > 1).any():
                mid = (yes_i + no_i) // 2
                near = np.abs(v - mid.view(np.float64)) <= r
                yes_i, no_i = np.where(near, mid, yes_i), np.where(near, no_i, mid)
            out.append(yes_i.view(np.float64))
        return out

    names = df.columns

    def run(batches):
        for t in batches:
            lo, hi = ends(t.column(value).to_numpy() + 0.0, t.column(radius).to_numpy() + 0.0)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(lo), pa.array(hi)], names=[*t.schema.names, "lo", "hi"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*names).mapInArrow(run, f"{shape}, lo double, hi double")


def count_within(points: DataFrame, asked: DataFrame, out: str, hold: Held) -> DataFrame:
    """``asked`` (with ``g``, ``lo``, ``hi``) with ``out``: the weight ``w`` of the ``points`` (``g``, ``v``) in [lo, hi].

    Points and the ends asked for are range-partitioned together; running sums within partitions and the partitions'
    totals (partitions and groups in number) give every end its rank, which joins back by value.
    """
    low, high = asked.select("g", F.col("lo").alias("v"), F.lit(0).alias("o")).distinct(), asked.select("g", F.col("hi").alias("v"), F.lit(2).alias("o")).distinct()
    marks = low.union(high).withColumn("w", F.lit(0).cast("long"))
    own = points.groupBy("g", "v").agg(F.sum("w").alias("w")).select("g", "v", F.lit(1).alias("o"), "w")
    laid = hold(own.union(marks).repartitionByRange("g", "v", "o").withColumn("pid", F.spark_partition_id()))
    seen: dict[str, int] = {}
    starts = []
    for row in laid.groupBy("g", "pid").agg(F.sum("w").alias("w")).orderBy("g", "pid").collect():
        starts.append((row.g, row.pid, seen.get(row.g, 0)))
        seen[row.g] = seen.get(row.g, 0) + row.w
    before = points.sparkSession.createDataFrame(starts, "g string, pid int, before bigint")
    w = Window.partitionBy("g", "pid").orderBy("v", "o").rowsBetween(Window.unboundedPreceding, 0)
    ranks = laid.withColumn("n", F.sum("w").over(w)).where("o <> 1").join(before, ["g", "pid"]).select("g", "v", "o", (F.col("n") + F.col("before")).alias("n"))
    below = ranks.where("o = 0").select("g", F.col("v").alias("lo"), F.col("n").alias("n_lo"))
    upto = ranks.where("o = 2").select("g", F.col("v").alias("hi"), F.col("n").alias("n_hi"))
    return asked.join(below, ["g", "lo"]).join(upto, ["g", "hi"]).withColumn(out, F.col("n_hi") - F.col("n_lo")).drop("lo", "hi", "n_lo", "n_hi")
