"""Category encoders over string columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, InPlace, Model, appended, chosen, in_place, no_collision, non_empty, replaced, strings
from quern.errors import InvalidInput
from quern.functions.exprs import finite, num, q

#: Larger maps are looked up in a broadcast-or-shuffled join instead of a literal.
LITERAL = 10_000


def category_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, list[tuple[str, int]]]:
    """Non-null categories with their counts, sorted, for all columns in one job."""
    columns = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(columns)])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n")).collect()
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in rows:
        out[columns[r.i]].append((r.v, r.n))
    for c in columns:
        out[c].sort(key=lambda x: x[0].encode())
    return out


class Lookup(Model):
    """Replaces string columns by values looked up per category.

    Maps of up to ``LITERAL`` categories are a hash lookup in a literal; larger ones join a table of the categories.
    """

    def __init__(self, maps: dict[str, dict[str, object]], kind: str, other: dict[str, object], only: bool):
        self.maps, self.kind, self.other, self.only = maps, kind, other, only

    def required(self):
        return [(c, T.StringType) for c in self.maps]

    def _temp(self, name: str) -> str:
        return f"__lookup_{list(self.maps).index(name)}"

    def prepare(self, df):
        for c, m in self.maps.items():
            if len(m) > LITERAL:
                rows = df.sparkSession.createDataFrame([(k, v) for k, v in m.items()], f"k string, v {self.kind}")
                table = rows.select(F.col("k").alias("__k"), F.col("v").alias(self._temp(c)))
                df = df.join(table, q(c) == F.col("__k"), "left").drop("__k")
        return df

    def value(self, name: str) -> Column:
        m, other = self.maps[name], F.lit(self.other.get(name)).cast(self.kind)
        if len(m) > LITERAL:
            found = q(self._temp(name))
        else:
            found = F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), q(name)).cast(self.kind) if m else F.lit(None).cast(self.kind)
        return F.when(q(name).isNotNull(), F.coalesce(found, other))

    def outputs(self, schema):
        new = {c: self.value(c) for c in self.maps}
        return list(new.items()) if self.only else in_place(schema, new)


class OneHot(Model):
    def __init__(self, levels: dict[str, list[str]], drop_first: bool, handle_unknown: str):
        self.levels, self.drop_first, self.handle_unknown = levels, drop_first, handle_unknown

    def required(self):
        return [(c, T.StringType) for c in self.levels]

    def outputs(self, schema):
        out = []
        for c, levels in self.levels.items():
            for v in levels[1 if self.drop_first else 0 :]:
                out.append((f"{c}_{v}", F.when(q(c) == v, 1.0).otherwise(0.0)))
        no_collision([n for n, _ in out])
        return out

    def precheck(self, df):
        if self.handle_unknown == "error":
            for c, levels in self.levels.items():
                odd = df.where(q(c).isNotNull() & ~q(c).isin(levels)).select(q(c)).limit(1).collect()
                if odd:
                    raise InvalidInput(f"column '{c}' has the unknown category '{odd[0][0]}'; known are {levels[:12]}")


class OneHotEncoder(Estimator):
    """0/1 columns ``{col}_{category}``, categories sorted; only they survive. A null row is all zeros."""

    def __init__(self, drop_first: bool = False, handle_unknown: str = "error"):
        if handle_unknown not in ("error", "ignore"):
            raise InvalidInput(f"unknown policy '{handle_unknown}'")
        self.drop_first, self.handle_unknown = drop_first, handle_unknown

    def _fit(self, df, target=None):
        non_empty(df)
        counts = category_counts(df, strings(df))
        model = OneHot({c: [v for v, _ in rows] for c, rows in counts.items()}, self.drop_first, self.handle_unknown)
        model.outputs(df.schema)
        return model


class LabelEncoder(Estimator):
    """One string column to the index of its category among the sorted ones; unseen and null give null."""

    def _fit(self, df, target=None):
        if len(df.columns) != 1 or not isinstance(df.schema[0].dataType, T.StringType):
            raise InvalidInput("exactly one string column is expected")
        return _ordinal(df)


class OrdinalEncoder(Estimator):
    """Every column, all of them strings, to the index of its category."""

    def _fit(self, df, target=None):
        if not df.columns:
            raise InvalidInput("the frame has no columns")
        for f in df.schema.fields:
            if not isinstance(f.dataType, T.StringType):
                raise InvalidInput(f"column '{f.name}' is {f.dataType.simpleString()}, expected string")
        return _ordinal(df)


def _ordinal(df: DataFrame) -> Lookup:
    maps = {c: {v: i for i, (v, _) in enumerate(rows)} for c, rows in category_counts(df, df.columns).items()}
    for c, m in maps.items():
        if not m:
            raise InvalidInput(f"column '{c}' has no category")
    return Lookup(maps, "bigint", {}, only=True)


class CountEncoder(Estimator):
    """Each category's count; unseen 0, null null. Only the string columns survive."""

    def _fit(self, df, target=None):
        non_empty(df)
        cols = strings(df)
        return Lookup({c: dict(rows) for c, rows in category_counts(df, cols).items()}, "bigint", dict.fromkeys(cols, 0), only=True)


class FrequencyEncoder(Estimator):
    """Each category's share of the non-null rows; unseen 0."""

    def _fit(self, df, target=None):
        non_empty(df)
        cols = strings(df)
        maps = {}
        for c, rows in category_counts(df, cols).items():
            total = sum(n for _, n in rows)
            if not total:
                raise InvalidInput(f"column '{c}' has no category")
            maps[c] = {v: n / total for v, n in rows}
        return Lookup(maps, "double", dict.fromkeys(cols, 0.0), only=True)


class Bits(Lookup):
    def __init__(self, maps, width):
        super().__init__(maps, "bigint", dict.fromkeys(maps, 0), only=False)
        self.width = width

    def outputs(self, schema):
        return replaced(schema, {c: [(f"{c}_bit_{j}", F.shiftright(self.value(c), j).bitwiseAND(F.lit(1))) for j in range(self.width[c])] for c in self.maps})


class BinaryEncoder(Estimator):
    """The category's index in binary, lowest bit first, as ``{col}_bit_{j}``; unseen like the first category."""

    def _fit(self, df, target=None):
        non_empty(df)
        maps = {c: {v: i for i, (v, _) in enumerate(rows)} for c, rows in category_counts(df, strings(df)).items()}
        maps = {c: m for c, m in maps.items() if m}
        if not maps:
            raise InvalidInput("no string column has a category")
        model = Bits(maps, {c: max(1, math.ceil(math.log2(len(m)))) for c, m in maps.items()})
        model.outputs(df.schema)
        return model


def target_column(df: DataFrame, target: str) -> None:
    if not isinstance(df.schema[target].dataType, T.DoubleType):
        raise InvalidInput(f"the target '{target}' is {df.schema[target].dataType.simpleString()}, expected double")


def target_sums(df: DataFrame, cols: list[str], target: str):
    """(global mean, {col: {category: (sum, count)}}) over finite targets."""
    y = finite(q(target))
    mean = df.agg(F.avg(y)).first()[0]
    if mean is None:
        raise InvalidInput("the target has no finite value")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(cols)])
    rows = df.select(F.explode(pairs).alias("p"), y.alias("y")).where("p.v is not null and y is not null")
    sums: dict[str, dict[str, tuple[float, int]]] = {c: {} for c in cols}
    for r in rows.groupBy("p.i", "p.v").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect():
        sums[cols[r.i]][r.v] = (r.s, r.n)
    if not all(math.isfinite(v[0]) for m in sums.values() for v in m.values()) or not math.isfinite(mean):
        raise InvalidInput("an encoding is not finite")
    return mean, sums


class TargetEncoder(Estimator):
    """(sum + alpha * mean) / (n + alpha) of the target per category; unseen categories get the mean."""

    supervised = True

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def _fit(self, df, target):
        if not math.isfinite(self.alpha) or self.alpha < 0:
            raise InvalidInput("alpha must be finite and not negative")
        target_column(df, target)
        non_empty(df)
        cols = strings(df, target)
        mean, sums = target_sums(df, cols, target)
        maps = {c: {v: (s + self.alpha * mean) / (n + self.alpha) for v, (s, n) in m.items()} for c, m in sums.items()}
        return Lookup(maps, "double", dict.fromkeys(cols, mean), only=False)


class LeaveOneOut(Model):
    def __init__(self, df, cols, target, alpha, mean, sums):
        self.cols, self.target, self.alpha, self.mean, self.sums = cols, target, alpha, mean, sums
        self.columns = sorted(df.columns)
        self.print = self._fingerprint(df)
        g = mean
        full = {c: {v: n / (n + alpha) * (s / n) + (1 - n / (n + alpha)) * g for v, (s, n) in m.items()} for c, m in sums.items()}
        self.unseen = Lookup(full, "double", dict.fromkeys(cols, g), only=False)

    def required(self):
        return [(c, T.StringType) for c in self.cols]

    def _fingerprint(self, df):
        cols = [q(c) for c in self.columns]
        h = F.xxhash64(*cols, *[c.isNull() for c in cols]).cast("decimal(38,0)")
        return tuple(df.agg(F.count("*"), F.sum(h)).first())

    def prepare(self, df):
        for i, c in enumerate(self.cols):
            if len(self.sums[c]) > LITERAL:
                rows = df.sparkSession.createDataFrame([(v, s, n) for v, (s, n) in self.sums[c].items()], "k string, s double, n bigint")
                table = rows.select(F.col("k").alias("__k"), F.struct("s", "n").alias(f"__loo_{i}"))
                df = df.join(table, q(c) == F.col("__k"), "left").drop("__k")
        return df

    def _sums(self, i: int, name: str) -> Column:
        if len(self.sums[name]) > LITERAL:
            return q(f"__loo_{i}")
        if not self.sums[name]:
            return F.lit(None).cast("struct<s:double,n:int>")
        table = {v: F.struct(num(s).alias("s"), F.lit(n).alias("n")) for v, (s, n) in self.sums[name].items()}
        return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), q(name))

    def outputs(self, schema):
        y, new = finite(q(self.target)), {}
        for i, c in enumerate(self.cols):
            at = self._sums(i, c)
            left = at["n"] - F.when(y.isNotNull(), 1).otherwise(0)
            total = at["s"] - F.coalesce(y, num(0))
            w = left / (left + num(self.alpha))
            value = F.when(left >= 1, w * (total / F.when(left >= 1, left)) + (num(1) - w) * num(self.mean)).otherwise(num(self.mean))
            new[c] = F.when(q(c).isNotNull(), value)
        return in_place(schema, new)

    def precheck(self, df):
        """Only the training frame is transformed: its own rows' targets are left out."""
        if sorted(df.columns) != self.columns or self._fingerprint(df) != self.print:
            raise InvalidInput("transform takes the training frame only; use transform_unseen for other rows")

    def transform_unseen(self, df):
        """Other rows: full-sample means. The target need not be there."""
        return self.unseen.transform(df)


class LeaveOneOutEncoder(Estimator):
    """Mean target of the category without the row's own, blended with the global mean by ``n / (n + alpha)``."""

    supervised = True

    def __init__(self, alpha: float = 0.0):
        self.alpha = alpha

    def _fit(self, df, target):
        if not math.isfinite(self.alpha) or self.alpha < 0:
            raise InvalidInput("alpha must be finite and not negative")
        target_column(df, target)
        non_empty(df)
        cols = strings(df, target)
        return LeaveOneOut(df, cols, target, self.alpha, *target_sums(df, cols, target))

    def transform_unseen(self, df):
        return self.model.transform_unseen(df)


def _hashed(values: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of distinct binary values, by two MD5 hashes."""
    md5 = [(hashlib.md5(v).digest(), hashlib.md5(b"sign:" + v).digest()) for v in values.to_pylist()]
    return np.array([int.from_bytes(h[:4], "big") % n for h, _ in md5], np.int64), np.array([1 - 2 * (s[3] & 1) for _, s in md5], np.int64)


def _dense(cells: pa.Array, columns: int, n: int, small: str) -> pa.Array:
    """Sums of the signs by bucket, ``n`` a row. ``cells`` are lists of ``columns`` binary values, or of 2 * bucket + (sign < 0)."""
    flat, rows = cells.flatten(), len(cells)
    if pa.types.is_integer(flat.type):
        code = flat.fill_null(0).to_numpy(zero_copy_only=False)
        bucket, sign = code >> 1, 1 - 2 * (code & 1)
    else:
        coded = flat.dictionary_encode()
        at = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        buckets, signs = _hashed(coded.dictionary, n)
        bucket, sign = (buckets[at], signs[at]) if len(buckets) else (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
    if flat.null_count:
        sign = np.where(flat.is_null().to_numpy(zero_copy_only=False), 0, sign)
    out = np.zeros((rows, n), small)
    bucket, sign, row = bucket.reshape(rows, columns), sign.astype(small).reshape(rows, columns), np.arange(rows)
    for i in range(columns):  # a column has one value a row, so no cell is met twice
        out[row, bucket[:, i]] += sign[:, i]
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(n)), pa.array(out.reshape(-1)))


class Buckets(Model):
    def __init__(self, columns, n, fast):
        self.columns, self.n, self.fast = columns, n, fast

    def required(self):
        return [(c, T.StringType) for c in self.columns]

    def prepare(self, df):
        """Each row's sums by bucket, once: an array of small numbers. Equal values of a batch are hashed once."""
        if self.fast:
            codes = [F.pmod(F.xxhash64(q(c)), F.lit(self.n)) * 2 + F.pmod(F.xxhash64(F.concat(F.lit("sign:"), q(c))), F.lit(2)) for c in self.columns]
            cells = [F.when(q(c).isNotNull(), x) for c, x in zip(self.columns, codes, strict=True)]
        else:
            cells = [q(c).cast("binary") for c in self.columns]
        small, kind = next((s, k) for most, s, k in ((127, "int8", "tinyint"), (32767, "int16", "smallint"), (math.inf, "int32", "int")) if len(cells) <= most)
        columns, n = len(cells), self.n

        @F.arrow_udf(f"array<{kind}>")
        def dense(x: pa.Array) -> pa.Array:
            return _dense(x, columns, n, small)

        return df.withColumn(_CELLS, dense(F.array(*cells)))

    def outputs(self, schema):
        return [(f"hashed_{i}", F.expr(f"coalesce(cast(get({_CELLS}, {i}) as double), 0D)")) for i in range(self.n)]


_CELLS = "__hashed_cells"


class FeatureHasher(Estimator):
    """Signed hashing of string columns into shared buckets ``hashed_{i}``; null adds nothing. Only buckets survive.

    Buckets and signs come from two MD5 hashes (the same value in any database), or from xxHash64 with ``fast``.
    """

    def __init__(self, columns: list[str], n_features: int, fast: bool = False):
        self.columns, self.n_features, self.fast = columns, n_features, fast

    def _fit(self, df, target=None):
        if self.n_features < 1:
            raise InvalidInput("n_features must be at least 1")
        chosen(df, self.columns, T.StringType)
        non_empty(df)
        return Buckets(list(self.columns), self.n_features, self.fast)


class Grouped(InPlace):
    kind = T.StringType

    def __init__(self, kept, other, null_is_rare):
        super().__init__(list(kept))
        self.kept, self.other, self.null_is_rare = kept, other, null_is_rare

    def expr(self, name):
        rest = F.when(q(name).isNull(), F.lit(self.other) if self.null_is_rare else None).otherwise(F.lit(self.other))
        return F.when(q(name).isin(self.kept[name]), q(name)).otherwise(rest) if self.kept[name] else rest


class RareCategoryGrouper(Estimator):
    """Categories under ``min_count`` (or ``min_frequency`` of the non-null rows), and unseen ones, become one label."""

    def __init__(self, columns: list[str] | None = None, min_count: int = 5, min_frequency: float | None = None, other_label: str = "Other", treat_null_as_rare: bool = False):
        self.columns, self.min_count, self.min_frequency = columns, min_count, min_frequency
        self.other_label, self.treat_null_as_rare = other_label, treat_null_as_rare

    def _fit(self, df, target=None):
        if self.min_frequency is not None and not 0 <= self.min_frequency <= 1:
            raise InvalidInput("min_frequency must lie in [0, 1]")
        cols = chosen(df, self.columns, T.StringType)
        non_empty(df)
        kept = {}
        for c, rows in category_counts(df, cols).items():
            total = sum(n for _, n in rows)
            kept[c] = [v for v, n in rows if (n >= self.min_count if self.min_frequency is None else n / total >= self.min_frequency)]
        return Grouped(kept, self.other_label, self.treat_null_as_rare)


class Cyclic(Model):
    def __init__(self, periods):
        self.periods = periods

    def required(self):
        return [(c, T.DoubleType) for c in self.periods]

    def outputs(self, schema):
        new = []
        for c, p in self.periods.items():
            angle = q(c) * num(2 * math.pi) / num(p)
            new += [(f"{c}_sin", F.sin(angle)), (f"{c}_cos", F.cos(angle))]
        return appended(schema, new, checked=False)


class CyclicalEncoder(Estimator):
    """``{c}_sin`` and ``{c}_cos`` of 2 pi v / period."""

    def __init__(self, columns: list[str], period: float | list[float]):
        self.columns, self.periods = columns, period if isinstance(period, list) else [period] * len(columns)

    def _fit(self, df, target=None):
        if len(self.periods) != len(self.columns) or any(not math.isfinite(p) or p < 1 for p in self.periods):
            raise InvalidInput("every column needs a period of at least 1")
        chosen(df, self.columns, T.DoubleType)
        non_empty(df)
        return Cyclic(dict(zip(self.columns, map(float, self.periods), strict=True)))
