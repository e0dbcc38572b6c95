"""Composition: pipelines, column transformers, unions, routing, caching. One select, never a join by position."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, Model, no_collision, non_empty
from quern.errors import Computation, InvalidInput, QuernError
from quern.functions.exprs import q

Steps = Sequence[tuple[str, Estimator]]


class PipelineModel(Model):
    def __init__(self, steps: list[tuple[str, Model]]):
        self.steps = steps

    def transform(self, df):
        for i, (name, m) in enumerate(self.steps):
            try:
                df = m.transform(df)
            except QuernError as e:
                raise type(e)(f"step {i} '{name}': {e}") from e
        return df

    def _plan(self, schema: T.StructType):
        from pyspark.sql import SparkSession

        return self.transform(SparkSession.getActiveSession().createDataFrame([], schema))

    def outputs(self, schema):
        raise NotImplementedError("a pipeline is applied step by step")

    def feature_names_out(self, names):
        schema = names if isinstance(names, T.StructType) else self.steps[0][1]._guess(names)
        return self._plan(schema).columns

    def inverse_transform(self, df):
        for _, m in reversed(self.steps):
            df = m.inverse_transform(df)
        return df


class Pipeline(Estimator):
    """Each step is fitted on what the earlier ones make; all transforms are one lazy plan."""

    def __init__(self, steps: Steps):
        if not steps:
            raise InvalidInput("a pipeline needs a step")
        self.steps = list(steps)

    def _fit(self, df, target=None):
        non_empty(df)
        models = []
        for i, (name, est) in enumerate(self.steps):
            try:
                model = est.fit(df, target if est.supervised else None)
                models.append((name, model))
                if i + 1 < len(self.steps):
                    df = model.transform(df)
            except QuernError as e:
                raise type(e)(f"step {i} '{name}': {e}") from e
        return PipelineModel(models)


class Wrapped(Model):
    """A model that only adds knowledge to another."""

    def __init__(self, inner: Model):
        self.inner = inner

    def required(self):
        return self.inner.required()

    def precheck(self, df):
        self.inner.precheck(df)

    def transform(self, df):
        return self.inner.transform(df)

    def outputs(self, schema):
        return self.inner.outputs(schema)

    def feature_names_out(self, names):
        return self.inner.feature_names_out(names)


def bare(m: Model) -> Model:
    while isinstance(m, Wrapped):
        m = m.inner
    return m


def plain(m: Model) -> bool:
    """Whether a model is expressions over its input and nothing else."""
    m = bare(m)
    if isinstance(m, PipelineModel):
        return False
    return all(plain(p) for _, p, _ in m.parts) if isinstance(m, Parallel) else type(m).prepare is Model.prepare


ROW = "__row"


def carried(df: DataFrame, m: Model) -> DataFrame:
    """Apply a model to all columns but ``__row``, which travels along."""
    m = bare(m)
    if isinstance(m, PipelineModel):
        for _, step in m.steps:
            df = carried(df, step)
        return df
    if isinstance(m, Parallel):
        return Parallel(m.parts, [*m.passed, ROW]).transform(df)
    own = T.StructType([f for f in df.schema.fields if f.name != ROW])
    m.check(own)
    m.precheck(df.select(*[q(c) for c in own.names]))
    return m.prepare(df).select(ROW, *[c.alias(n) for n, c in m.outputs(own)])


class Parallel(Model):
    """Models side by side over parts of one frame, then columns that pass.

    Parts that are plain expressions are one select. A part that needs helper columns or several steps works on its own
    columns while the row travels along in a struct, so rows are never matched by position.
    """

    def __init__(self, parts: list[tuple[str, Model, list[str]]], passed: list[str]):
        self.parts, self.passed = parts, passed

    def required(self):
        return [(c, None) for _, _, cols in self.parts for c in cols] + [(c, None) for c in self.passed]

    def transform(self, df):
        self.check(df.schema)
        schema, ready, temps = df.schema, [], 0
        for _, m, cols in self.parts:
            part = T.StructType([schema[c] for c in cols])
            m.check(part)
            if plain(m):
                m.precheck(df.select(*[q(c) for c in cols]))
                ready += m.outputs(part)
            else:
                inner = carried(df.select(F.struct(*[q(c) for c in df.columns]).alias(ROW), *[q(c) for c in cols]), m)
                made = [c for c in inner.columns if c != ROW]
                df = inner.select(*[q(ROW).getField(c).alias(c) for c in df.columns], *[q(c).alias(f"__t{temps + i}") for i, c in enumerate(made)])
                ready += [(c, q(f"__t{temps + i}")) for i, c in enumerate(made)]
                temps += len(made)
        ready += [(c, q(c)) for c in self.passed]
        no_collision([n for n, _ in ready])
        if not ready:
            raise InvalidInput("there is no output column")
        return df.select(*[c.alias(n) for n, c in ready])

    def outputs(self, schema):
        if not plain(self):
            raise NotImplementedError("a part of this composition is applied in steps; use transform")
        out = [x for _, m, cols in self.parts for x in m.outputs(T.StructType([schema[c] for c in cols]))]
        out += [(c, q(c)) for c in self.passed]
        no_collision([n for n, _ in out])
        return out

    def feature_names_out(self, names):
        schema = names if isinstance(names, T.StructType) else self._guess(names)
        out = [n for _, m, cols in self.parts for n in m.feature_names_out(T.StructType([schema[c] for c in cols]))] + self.passed
        no_collision(out)
        return out

    def _guess(self, names):
        kinds = {f.name: f for _, m, cols in self.parts for f in m._guess(cols).fields}
        return T.StructType([kinds.get(n, T.StructField(n, T.DoubleType())) for n in names])


class ColumnTransformer(Estimator):
    """Transformers on disjoint column sets, outputs in their order, then the remainder (``drop`` or ``passthrough``)."""

    def __init__(self, transformers: Sequence[tuple[str, Estimator, Sequence[str]]], remainder: str = "drop"):
        if remainder not in ("drop", "passthrough"):
            raise InvalidInput(f"unknown remainder '{remainder}'")
        self.transformers, self.remainder = list(transformers), remainder

    def _fit(self, df, target=None):
        non_empty(df)
        used: set[str] = set()
        for name, _, cols in self.transformers:
            for c in cols:
                if c not in df.columns:
                    raise InvalidInput(f"transformer '{name}': column '{c}' is missing")
                if c in used:
                    raise InvalidInput(f"column '{c}' belongs to two transformers")
                used.add(c)
        parts = []
        for name, est, cols in self.transformers:
            try:
                own = [*cols, *([target] if est.supervised and target is not None and target not in cols else [])]
                parts.append((name, est.fit(df.select(*[q(c) for c in own]), target if est.supervised else None), list(cols)))
            except QuernError as e:
                raise Computation(f"transformer '{name}': {e}") from e
        rest = [c for c in df.columns if c not in used] if self.remainder == "passthrough" else []
        model = Parallel(parts, rest)
        if not model.feature_names_out(df.schema):
            raise InvalidInput("there is no output column")
        return model


class FeatureUnion(Estimator):
    """Every transformer gets the whole frame; their outputs stand side by side."""

    def __init__(self, transformers: Steps):
        self.transformers = list(transformers)

    def n_components(self) -> int:
        return len(self.transformers)

    def _fit(self, df, target=None):
        if not self.transformers:
            raise InvalidInput("a union needs a transformer")
        non_empty(df)
        parts = []
        for i, (name, est) in enumerate(self.transformers):
            try:
                parts.append((name, est.fit(df, target if est.supervised else None), df.columns))
            except QuernError as e:
                raise type(e)(f"transformer {i} '{name}': {e}") from e
        model = Parallel(parts, [])
        model.feature_names_out(df.schema)
        return model


Predicate = Callable[[DataFrame, T.StructField], bool]


def is_float64(df, field):
    return isinstance(field.dataType, T.DoubleType)


def is_int(df, field):
    return isinstance(field.dataType, T.IntegralType)


def is_string(df, field):
    return isinstance(field.dataType, T.StringType)


def is_datetime(df, field):
    """Timestamps; plain dates are not among them."""
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))


def is_boolean(df, field):
    return isinstance(field.dataType, T.BooleanType)


def name_matches(pattern: str) -> Predicate:
    """Columns in whose name the pattern occurs anywhere."""
    try:
        found = re.compile(pattern)
    except re.error as e:
        raise InvalidInput(f"bad pattern '{pattern}': {e}") from e
    return lambda df, field: bool(found.search(field.name))


class ConditionalPipeline(Estimator):
    """Routes each column to the first rule whose predicate holds, else to the fallback, else drops it.

    A predicate is called once per column with the frame and the column's field, at fit only; the routing is kept.
    """

    def __init__(self, rules: Sequence[tuple[Predicate, Estimator]] = (), fallback: Estimator | None = None):
        self.rules, self.fallback = list(rules), fallback
        self.routes: dict[str, int | None] = {}

    def rule(self, predicate: Predicate, transformer: Estimator) -> ConditionalPipeline:
        self.rules.append((predicate, transformer))
        return self

    def n_rules(self) -> int:
        return len(self.rules)

    def assignments(self) -> dict[str, int | None]:
        """{column: its rule's number}; None stands for the fallback."""
        return dict(self.routes)

    def _fit(self, df, target=None):
        if not self.rules and self.fallback is None:
            raise InvalidInput("a conditional pipeline needs a rule or a fallback")
        non_empty(df)
        self.routes, groups = {}, {}
        for f in df.schema.fields:
            at = next((i for i, (p, _) in enumerate(self.rules) if p(df, f)), None)
            if at is None and self.fallback is None:
                continue
            self.routes[f.name] = at
            groups.setdefault(at, []).append(f.name)
        parts = []
        for at in [*range(len(self.rules)), None]:
            if at in groups:
                est = self.fallback if at is None else self.rules[at][1]
                parts.append((f"rule {at}" if at is not None else "fallback", est.fit(df.select(*[q(c) for c in groups[at]])), groups[at]))
        model = Parallel(parts, [])
        if not parts or not model.feature_names_out(df.schema):
            raise InvalidInput("there is no output column")
        return model


class CachedPipeline(Estimator):
    """Keeps the persisted results of the last ``max_cache_entries`` distinct transforms, first in first out.

    A result is found again by its input's schema and plan (``semanticHash``): frames that read the same data in the
    same way share it. It identifies plans, not file contents. 0 keeps nothing; a new fit clears the cache.
    """

    def __init__(self, pipeline: Estimator | None, max_cache_entries: int = 16):
        self.pipeline, self.max_cache_entries = pipeline, max_cache_entries
        self.cache: OrderedDict[tuple, DataFrame] = OrderedDict()

    def cache_size(self) -> int:
        return len(self.cache)

    def clear_cache(self) -> None:
        for df in self.cache.values():
            df.unpersist()
        self.cache.clear()

    def _fit(self, df, target=None):
        self.clear_cache()
        if self.pipeline is None:
            raise InvalidInput("there is no pipeline to cache")
        return self.pipeline.fit(df, target)

    def transform(self, df):
        out = super().transform
        if self.model is None or not self.max_cache_entries:
            return out(df)
        key = (df.schema.json(), df.semanticHash())
        if key not in self.cache:
            made = out(df).persist()
            while len(self.cache) >= self.max_cache_entries:
                self.cache.popitem(last=False)[1].unpersist()
            self.cache[key] = made
        return self.cache[key]
