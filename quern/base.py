"""Estimators learn from a frame, models are lists of named Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from quern.errors import InvalidInput, NotFitted
from quern.functions.exprs import q
from quern.session import ship

Named = tuple[str, Column]


class Model:
    """What a fit has learned.

    ``outputs(schema)`` gives the complete output, in order, as ``(name, expression)``; ``transform`` is one ``select``
    of it. ``prepare`` adds helper columns first where expressions alone cannot do (grouped maps).
    """

    invertible = False

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def outputs(self, schema: T.StructType) -> list[Named]:
        raise NotImplementedError

    def precheck(self, df: DataFrame) -> None:
        """Reject rows this model cannot transform, where that is found out before the transform."""

    def check(self, schema: T.StructType) -> None:
        """Reject a schema this model cannot transform."""
        for name, kind in self.required():
            if name not in schema.names:
                raise InvalidInput(f"column '{name}' is missing; there are {schema.names}")
            if kind is not None and not isinstance(schema[name].dataType, kind):
                raise InvalidInput(f"column '{name}' is {schema[name].dataType.simpleString()}, expected {kind.__name__}")

    def required(self) -> list[tuple[str, Any]]:
        """Columns with their types (None: any) that ``transform`` reads."""
        return []

    def transform(self, df: DataFrame) -> DataFrame:
        self.check(df.schema)
        self.precheck(df)
        return self.prepare(df).select(*[c.alias(n) for n, c in self.outputs(df.schema)])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise InvalidInput(f"{type(self).__name__} has no inverse")

    def feature_names_out(self, names: Sequence[str] | T.StructType) -> list[str]:
        """Output names for input names (or a schema), without data."""
        schema = names if isinstance(names, T.StructType) else self._guess(names)
        return [n for n, _ in self.outputs(schema)]

    def _guess(self, names: Iterable[str]) -> T.StructType:
        kinds = dict(self.required())
        make = {T.StringType: T.StringType(), T.DoubleType: T.DoubleType()}
        return T.StructType([T.StructField(n, make.get(kinds.get(n), T.DoubleType())) for n in names])


class Estimator:
    """Settings plus ``fit``; it also remembers its last model, so that ``fit`` and ``transform`` can be chained.

    A failed fit forgets the model of an earlier one.
    """

    model: Model | None = None
    supervised = False

    def _fit(self, df: DataFrame, target: str | None) -> Model:
        raise NotImplementedError

    def fit(self, df: DataFrame, target: str | None = None) -> Model:
        self.model = None
        if self.supervised and target is None:
            raise InvalidInput(f"{type(self).__name__} needs a target column")
        if target is not None and target not in df.columns:
            raise InvalidInput(f"target column '{target}' is missing")
        ship(df.sparkSession)
        self.model = self._fit(df, target)
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted(f"{type(self).__name__} has not been fitted")
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotFitted(f"{type(self).__name__} has not been fitted")
        return self.model.inverse_transform(df)

    def feature_names_out(self, names: Sequence[str] | T.StructType) -> list[str]:
        if self.model is None:
            raise NotFitted(f"{type(self).__name__} has not been fitted")
        return self.model.feature_names_out(names)


def columns_of(schema: T.StructType, *kinds: type) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def doubles(df: DataFrame, skip: str | None = None) -> list[str]:
    """All Float64 columns; it is an error to have none."""
    found = [c for c in columns_of(df.schema, T.DoubleType) if c != skip]
    if not found:
        raise InvalidInput(f"no double column among {[f'{f.name}: {f.dataType.simpleString()}' for f in df.schema.fields]}")
    return found


def strings(df: DataFrame, skip: str | None = None) -> list[str]:
    found = [c for c in columns_of(df.schema, T.StringType) if c != skip]
    if not found:
        raise InvalidInput(f"no string column among {df.columns}")
    return found


def chosen(df: DataFrame, columns: Sequence[str] | None, kind: type, auto: list[str] | None = None) -> list[str]:
    """The given columns, checked, or all of this type."""
    if columns is None:
        found = auto if auto is not None else columns_of(df.schema, kind)
        if not found:
            raise InvalidInput(f"no {kind.__name__} column among {df.columns}")
        return found
    if not columns:
        raise InvalidInput("the list of columns is empty")
    for c in columns:
        if c not in df.columns:
            raise InvalidInput(f"column '{c}' is missing; there are {df.columns}")
        if not isinstance(df.schema[c].dataType, kind):
            raise InvalidInput(f"column '{c}' is {df.schema[c].dataType.simpleString()}, expected {kind.__name__}")
    return list(columns)


def non_empty(df: DataFrame) -> None:
    if not df.columns:
        raise InvalidInput("the frame has no columns")
    if df.isEmpty():
        raise InvalidInput("the frame has no rows")


def no_collision(new: Sequence[str], old: Iterable[str] = ()) -> None:
    seen = set(old)
    for n in new:
        if n in seen:
            raise InvalidInput(f"output column '{n}' would exist twice")
        seen.add(n)


def in_place(schema: T.StructType, changed: dict[str, Column]) -> list[Named]:
    return [(n, changed.get(n, q(n))) for n in schema.names]


def appended(schema: T.StructType, new: list[Named], checked: bool = True) -> list[Named]:
    if checked:
        no_collision([n for n, _ in new], schema.names)
        return [*((n, q(n)) for n in schema.names), *new]
    fresh = dict(new)
    return [*((n, fresh.pop(n) if n in fresh else q(n)) for n in schema.names), *fresh.items()]


def replaced(schema: T.StructType, new: dict[str, list[Named]]) -> list[Named]:
    out = [x for n in schema.names for x in (new[n] if n in new else [(n, q(n))])]
    no_collision([n for n, _ in out])
    return out


class InPlace(Model):
    """Replaces its columns by expressions over themselves."""

    kind: Any = T.DoubleType

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def required(self):
        return [(c, self.kind) for c in self.columns]

    def expr(self, name: str) -> Column:
        raise NotImplementedError

    def inverse(self, name: str) -> Column:
        raise NotImplementedError

    def outputs(self, schema):
        return in_place(schema, {c: self.expr(c) for c in self.columns})

    def inverse_transform(self, df):
        if not self.invertible:
            return super().inverse_transform(df)
        self.check(df.schema)
        return df.select(*[c.alias(n) for n, c in in_place(df.schema, {c: self.inverse(c) for c in self.columns})])


class Select(Model):
    """Keeps some columns, in a given order."""

    def __init__(self, columns: Sequence[str], scores: list[tuple[str, float]] | None = None):
        self.columns = list(columns)
        self.scores = scores

    def required(self):
        return [(c, None) for c in self.columns]

    def outputs(self, schema):
        return [(c, q(c)) for c in self.columns]
