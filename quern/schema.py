"""Schema requirements, checked on the frame's types without a job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.errors import InvalidInput


@dataclass(frozen=True)
class Requirement:
    """``named``: a column of a type; ``dtype``: at least ``least`` columns of a type; ``name_only``; ``all``: every column."""

    rule: str
    name: str | None = None
    dtype: T.DataType | None = None
    least: int = 1


@dataclass(frozen=True)
class Violation:
    rule: str  # missing_column, dtype_mismatch, insufficient_columns
    message: str


@dataclass
class SchemaSpec:
    requirements: list[Requirement] = field(default_factory=list)

    @classmethod
    def exact(cls, columns: Sequence[tuple[str, T.DataType]]) -> SchemaSpec:
        return cls([Requirement("named", n, t) for n, t in columns])

    @classmethod
    def f64_columns(cls, least: int = 1) -> SchemaSpec:
        return cls([Requirement("dtype", dtype=T.DoubleType(), least=least)])

    @classmethod
    def string_columns(cls, least: int = 1) -> SchemaSpec:
        return cls([Requirement("dtype", dtype=T.StringType(), least=least)])

    @classmethod
    def dtype_columns(cls, dtype: T.DataType, least: int = 1) -> SchemaSpec:
        return cls([Requirement("dtype", dtype=dtype, least=least)])

    @classmethod
    def all_columns(cls, dtype: T.DataType) -> SchemaSpec:
        return cls([Requirement("all", dtype=dtype)])

    @classmethod
    def names(cls, names: Sequence[str]) -> SchemaSpec:
        return cls([Requirement("name_only", n) for n in names])


def check_schema(df: DataFrame | T.StructType, spec: SchemaSpec) -> list[Violation]:
    schema = df.schema if isinstance(df, DataFrame) else df
    kinds = {f.name: f.dataType for f in schema.fields}
    out = []
    for r in spec.requirements:
        if r.rule in ("named", "name_only"):
            if r.name not in kinds:
                out.append(Violation("missing_column", f"column '{r.name}' is missing"))
            elif r.rule == "named" and kinds[r.name] != r.dtype:
                out.append(Violation("dtype_mismatch", f"column '{r.name}' is {kinds[r.name].simpleString()}, expected {r.dtype.simpleString()}"))
        elif r.rule == "dtype":
            n = sum(k == r.dtype for k in kinds.values())
            if n < r.least:
                out.append(Violation("insufficient_columns", f"{n} columns of type {r.dtype.simpleString()}, expected at least {r.least}"))
        else:
            out += [Violation("dtype_mismatch", f"column '{n}' is {k.simpleString()}, expected {r.dtype.simpleString()}") for n, k in kinds.items() if k != r.dtype]
    return out


def validate_schema(df: DataFrame | T.StructType, spec: SchemaSpec) -> None:
    """Raise one error that names every violation."""
    if found := check_schema(df, spec):
        raise InvalidInput("; ".join(v.message for v in found))
