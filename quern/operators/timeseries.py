"""Order-dependent features: windows over an explicit order, optionally per key.

Spark frames have no row order, so every operator takes ``order_by`` (columns that identify a row's place) and, for
series of many entities, ``partition_by``: then each entity is a series of its own and nothing is sorted globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from quern.base import Estimator, Model, appended, chosen, no_collision, non_empty
from quern.errors import InvalidInput
from quern.functions.exprs import EPSILON, NAN, not_nan, num, q

Names = str | Sequence[str]


def _list(names: Names | None) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


class Series(Model):
    def __init__(self, est: Ordered, new_columns):
        self.order_by, self.partition_by, self.columns = est.order_by, est.partition_by, est.columns
        self.new_columns = new_columns
        self.strict = est.strict

    def required(self):
        return [(c, None) for c in [*self.columns, *self.order_by, *self.partition_by]]

    def window(self) -> WindowSpec:
        w = Window.partitionBy(*[q(c) for c in self.partition_by]) if self.partition_by else Window.partitionBy()
        return w.orderBy(*[q(c) for c in self.order_by])

    def outputs(self, schema):
        return appended(schema, self.new_columns(self.window()), checked=self.strict)


class Ordered(Estimator):
    strict = False  # generated names replace existing columns
    kind: type | None = T.DoubleType

    def __init__(self, columns: Names, order_by: Names, partition_by: Names | None = None):
        self.columns, self.order_by, self.partition_by = _list(columns), _list(order_by), _list(partition_by)

    def start(self, df) -> None:
        if not self.columns:
            raise InvalidInput("no columns")
        if not self.order_by:
            raise InvalidInput("order_by is needed: a Spark frame has no row order")
        for c in [*self.columns, *self.order_by, *self.partition_by]:
            if c not in df.columns:
                raise InvalidInput(f"column '{c}' is missing")
        if self.kind:
            chosen(df, self.columns, self.kind)


class Lagger(Ordered):
    """``{c}_lag_{p}``: the value p rows earlier (later, if p is negative), of any type.

    New columns are built in order and replace ones of their name, so that a later lag of such a name reads what an
    earlier one built.
    """

    kind = None

    def __init__(self, columns, periods: int | Sequence[int], order_by, partition_by=None):
        super().__init__(columns, order_by, partition_by)
        self.periods = [periods] if isinstance(periods, int) else list(periods)

    def _fit(self, df, target=None):
        self.start(df)
        if not self.periods or len(set(self.periods)) < len(self.periods):
            raise InvalidInput("periods must be given and distinct")
        cols, periods = self.columns, self.periods
        built: dict[str, tuple[str, tuple[int, ...]]] = {}  # what a name stands for: a column of the frame, shifted in turn
        for c in cols:
            base, shifts = built.get(c, (c, ()))
            for p in periods:
                built[f"{c}_lag_{p}"] = base, (*shifts, p)
        return Series(self, lambda w: [(name, _shifted(base, shifts, w)) for name, (base, shifts) in built.items()])


def _shifted(base: str, shifts: tuple[int, ...], w: WindowSpec) -> Column:
    """A column shifted several times: null as soon as one shift leaves the rows."""
    out = F.lag(q(base), sum(shifts)).over(w)
    for k in range(1, len(shifts)):
        out = F.when(F.lag(F.lit(True), sum(shifts[k:])).over(w), out)
    return out


class Difference(Ordered):
    """``{c}_diff_{p}`` or, with ``pct``, ``{c}_pct_{p}`` (null where the earlier value is zero)."""

    def __init__(self, columns, period: int, order_by, partition_by=None, pct: bool = False):
        super().__init__(columns, order_by, partition_by)
        self.period, self.pct = period, pct

    def _fit(self, df, target=None):
        self.start(df)
        cols, p, pct = self.columns, self.period, self.pct

        def new(w):
            out = []
            for c in cols:
                old = F.lag(q(c), p).over(w)
                if pct:
                    out.append((f"{c}_pct_{p}", F.when(F.abs(old) > EPSILON, (q(c) - old) / F.when(F.abs(old) > EPSILON, old))))
                else:
                    out.append((f"{c}_diff_{p}", q(c) - old))
            return out

        return Series(self, new)


AGGREGATES = ("mean", "std", "min", "max", "sum")


def _over(name: str, c: Column, w: WindowSpec) -> Column:
    """An aggregate over a frame; min and max pass over NaN unless there is nothing else."""
    if name in ("min", "max"):
        f = F.min if name == "min" else F.max
        return F.coalesce(f(not_nan(c)).over(w), F.when(F.count(c).over(w) > 0, num(NAN)))
    return {"mean": F.avg, "sum": F.sum, "std": F.stddev_pop}[name](c).over(w)


class RollingAggregator(Ordered):
    """``{c}_{fn}_{w}`` over the trailing w rows; null before there are w rows or where one of them is null."""

    def __init__(self, columns, window: int, order_by, partition_by=None, function: str = "mean"):
        super().__init__(columns, order_by, partition_by)
        self.window, self.function = window, function

    def _fit(self, df, target=None):
        self.start(df)
        if self.window < 2:
            raise InvalidInput("the window must be at least 2")
        if self.function not in AGGREGATES:
            raise InvalidInput(f"unknown function '{self.function}'")
        cols, n, name = self.columns, self.window, self.function

        def new(w):
            f = w.rowsBetween(-(n - 1), 0)
            return [(f"{c}_{name}_{n}", F.when(F.count(q(c)).over(f) == n, _over(name, q(c), f))) for c in cols]

        return Series(self, new)


class ExpandingAggregator(Ordered):
    """``{c}_expanding_{fn}`` over all rows so far; null at null rows and before ``min_periods`` values."""

    def __init__(self, columns, order_by, partition_by=None, function: str = "mean", min_periods: int = 1):
        super().__init__(columns, order_by, partition_by)
        self.function, self.min_periods = function, min_periods

    def _fit(self, df, target=None):
        self.start(df)
        if self.min_periods < 1:
            raise InvalidInput("min_periods must be at least 1")
        if self.function not in AGGREGATES:
            raise InvalidInput(f"unknown function '{self.function}'")
        non_empty(df)
        cols, least, name = self.columns, self.min_periods, self.function

        def new(w):
            f = w.rowsBetween(Window.unboundedPreceding, 0)
            return [(f"{c}_expanding_{name}", F.when(q(c).isNotNull() & (F.count(q(c)).over(f) >= least), _over(name, q(c), f))) for c in cols]

        return Series(self, new)


def shown(x: float) -> str:
    """A number as decimal digits: whole numbers without a point, never an exponent."""
    if x == int(x):
        return str(int(x))
    text = repr(float(x))
    return text if "e" not in text else f"{x:.20f}".rstrip("0")


class EwmaState:
    """The recurrence for one series and column, row by row."""

    def __init__(self, alpha, statistic, adjust, min_periods, ignore_na):
        self.alpha, self.statistic, self.adjust = alpha, statistic, adjust
        self.min_periods, self.ignore_na = min_periods, ignore_na
        self.n, self.mean, self.var, self.sum, self.norm, self.dead = 0, 0.0, 0.0, 0.0, 0.0, False

    def step(self, x: float | None) -> float | None:
        if x is None or self.dead:
            self.dead = self.dead or not self.ignore_na
            return None
        a, self.n = self.alpha, self.n + 1
        if self.adjust:
            self.sum, self.norm = self.sum * (1 - a) + x, self.norm * (1 - a) + 1
        if self.n == 1:
            self.mean, self.var = x, 0.0
        else:
            d = x - self.mean
            self.var = (1 - a) * (self.var + a * d * d)
            self.mean = self.sum / self.norm if self.adjust and self.statistic == "mean" else a * x + (1 - a) * self.mean
        if self.n < max(self.min_periods, 1 if self.statistic == "mean" else 2):
            return None
        return self.mean if self.statistic == "mean" else self.var if self.statistic == "var" else math.sqrt(self.var)


class EwmaModel(Model):
    def __init__(self, est, alpha):
        self.est, self.alpha = est, alpha
        self.names = {c: f"{c}_ewm_{est.statistic}_{shown(alpha)}" for c in est.columns}

    def required(self):
        return [(c, T.DoubleType) for c in self.est.columns] + [(c, None) for c in [*self.est.order_by, *self.est.partition_by]]

    def outputs(self, schema):
        base = T.StructType([f for f in schema.fields if not f.name.startswith("__ewm_")])
        return appended(base, [(self.names[c], q(f"__ewm_{i}")) for i, c in enumerate(self.est.columns)])

    def prepare(self, df):
        """Series are sorted within their partition and streamed batch by batch with a constant state."""
        est, alpha, cols = self.est, self.alpha, self.est.columns
        old = df.schema
        shape = T.StructType([*old.fields, *(T.StructField(f"__ewm_{i}", T.DoubleType()) for i in range(len(cols)))])
        by = [q(c) for c in est.partition_by]
        arranged = df.repartition(*by) if by else df.repartition(1)
        return _stream(arranged.sortWithinPartitions(*by, *[q(c) for c in est.order_by]), shape, cols, est.partition_by, alpha, est)


def _stream(df, shape, cols, keys, alpha, est):
    settings = (alpha, est.statistic, est.adjust, est.min_periods, est.ignore_na)

    def run(batches):
        state, held = None, object()
        for b in batches:
            ks = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * b.num_rows
            xs = [b.column(c).to_pylist() for c in cols]
            out = [[] for _ in cols]
            for r in range(b.num_rows):
                if ks[r] != held:
                    held, state = ks[r], [EwmaState(*settings) for _ in cols]
                for j, s in enumerate(state):
                    out[j].append(s.step(xs[j][r]))
            new = [pa.array(o, pa.float64()) for o in out]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f"__ewm_{i}" for i in range(len(cols)))])

    return df.mapInArrow(run, shape)


class ExponentiallyWeightedMovingAverage(Ordered):
    """``{c}_ewm_{stat}_{alpha}``: exponentially weighted mean, variance (biased) or deviation.

    Exactly one of ``alpha``, ``span`` (2 / (s + 1)), ``com`` (1 / (1 + c)) and ``half_life`` (1 - 0.5 ** (1 / h)). A null
    ends the series (all null from there) unless ``ignore_na``, which leaves the state as it is.
    """

    def __init__(self, columns, order_by, partition_by=None, alpha=None, span=None, com=None, half_life=None, statistic="mean", adjust=True, min_periods=1, ignore_na=False):
        super().__init__(columns, order_by, partition_by)
        self.rate = {"alpha": alpha, "span": span, "com": com, "half_life": half_life}
        self.statistic, self.adjust, self.min_periods, self.ignore_na = statistic, adjust, min_periods, ignore_na

    def smoothing(self) -> float:
        given = {k: v for k, v in self.rate.items() if v is not None}
        if len(given) != 1:
            raise InvalidInput("give one of alpha, span, com and half_life")
        (how, v), = given.items()
        low, closed = {"alpha": (0, False), "span": (1, True), "com": (0, True), "half_life": (0, False)}[how]
        if not math.isfinite(v) or v < low or v == low and not closed or how == "alpha" and v > 1:
            raise InvalidInput(f"{how} is out of range")
        return {"alpha": lambda: float(v), "span": lambda: 2 / (v + 1), "com": lambda: 1 / (1 + v), "half_life": lambda: 1 - 0.5 ** (1 / v)}[how]()

    def _fit(self, df, target=None):
        self.start(df)
        if self.statistic not in ("mean", "var", "std"):
            raise InvalidInput(f"unknown statistic '{self.statistic}'")
        alpha = self.smoothing()
        non_empty(df)
        model = EwmaModel(self, alpha)
        no_collision(model.names.values(), df.columns)
        return model
