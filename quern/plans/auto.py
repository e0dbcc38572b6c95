"""Automatic choices: imputers, scalers, column types, whole pipelines."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, Model, Select, columns_of, doubles, non_empty
from quern.errors import Computation, InvalidInput, QuernError
from quern.functions.exprs import INF, finite, not_nan, num, q
from quern.functions.stats import column_stats, quantiles
from quern.operators.clean import StringCleaner
from quern.operators.encoders import FeatureHasher, OneHotEncoder, RareCategoryGrouper, TargetEncoder
from quern.operators.generate import DATES, DatetimeFeatures
from quern.operators.missing import ConstantColumnRemover, DuplicateColumnRemover, SimpleImputer
from quern.operators.nonlinear import PowerTransformer
from quern.operators.scalers import MaxAbsScaler, MinMaxScaler, RobustScaler, StandardScaler
from quern.plans.compose import ColumnTransformer, Parallel, Pipeline, PipelineModel, Wrapped, carried
from quern.schema import Requirement, SchemaSpec, validate_schema

SCALERS = {"MaxAbs": MaxAbsScaler, "Robust": RobustScaler, "Power": PowerTransformer, "MinMax": MinMaxScaler, "Standard": StandardScaler}


def shapes(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Counts, zeros, moments (central, in a second pass), quartiles and largest distance to the median of finite values."""
    first = column_stats(df, cols, {
        "n": F.count, "zeros": lambda x: F.sum(F.when(x == 0, 1).otherwise(0)), "mean": F.avg, "var": F.var_pop, "min": F.min, "max": F.max,
    })
    inf = df.agg(*[F.max(F.when(F.abs(q(c)) == INF, 1).otherwise(0)).alias(f"i{i}") for i, c in enumerate(cols)]).first()
    mids = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        d = finite(q(c)) - num(first[c]["mean"] if first[c]["mean"] is not None else 0.0)
        aggs += [F.avg(d * d * d).alias(f"c{i}"), F.avg(d * d * d * d).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    for i, c in enumerate(cols):
        first[c] |= {"inf": bool(inf[f"i{i}"]), "q": mids[c], "m3": row[f"c{i}"], "m4": row[f"d{i}"]}
    return first


def choose_scaler(s: dict) -> str:
    """Sparse or flat: MaxAbs; far outliers: Robust; skewed: Power; flat-topped: MinMax; else Standard."""
    var = s["var"]
    if s["zeros"] / s["n"] > 0.5 or var <= 1e-24 or not math.isfinite(var):
        return "MaxAbs"
    low, mid, high = s["q"]
    if high - low > 1e-12 and max(s["max"] - mid, mid - s["min"]) / (high - low) > 10:
        return "Robust"
    skew = s["m3"] / math.sqrt(var) ** 3
    if math.isfinite(skew) and abs(skew) > 1:
        return "Power"
    kurtosis = s["m4"] / var / var
    return "MinMax" if math.isfinite(kurtosis) and kurtosis < 2 and not s["inf"] else "Standard"


class Regrouped(Wrapped):
    """A composite that also tells what was chosen."""

    def __init__(self, inner: Model, kinds: dict[str, str]):
        super().__init__(inner)
        self.kinds = kinds


def _grouped(plan: dict[str, str], make) -> list:
    groups: dict[str, list[str]] = {}
    for c, kind in plan.items():
        groups.setdefault(kind, []).append(c)
    return [(kind, make(kind), cols) for kind, cols in groups.items()]


class AutoScaler(Estimator):
    """A scaler per column by its distribution; columns come out grouped by scaler, then the rest.

    ``strategy`` forces one. Power falls back to Robust and then Standard where it cannot be fitted.
    """

    def __init__(self, strategy: str = "Auto"):
        if strategy != "Auto" and strategy not in SCALERS:
            raise InvalidInput(f"unknown strategy '{strategy}'")
        self.strategy = strategy

    def column_types(self) -> dict[str, str]:
        return dict(self.model.kinds)

    def chosen_name(self, column: str) -> str | None:
        return self.model.kinds.get(column)

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        stats = shapes(df, cols)
        plan = {c: choose_scaler(stats[c]) if self.strategy == "Auto" else self.strategy for c in cols if stats[c]["n"]}
        if self.strategy == "Auto":
            for c in [c for c in plan if plan[c] == "Power"]:
                for kind in ("Power", "Robust", "Standard"):
                    try:
                        SCALERS[kind]().fit(df.select(q(c)))
                        plan[c] = kind
                        break
                    except QuernError:
                        continue
        inner = ColumnTransformer(_grouped(plan, lambda k: SCALERS[k]()), "passthrough").fit(df)
        return Regrouped(inner, plan)


class AutoImputer(Estimator):
    """Mean, or median for skewed columns; columns with a null share of ``high_null_threshold`` or more are left alone.

    ``force_strategy`` is SimpleImputer's. Columns without any value: ``drop``, ``error`` or ``fill`` (with 0, or the
    forced constant).
    """

    def __init__(self, force_strategy: str | float | None = None, high_null_threshold: float = 0.5, skew_threshold: float = 1.0, null_column_behavior: str = "drop"):
        if null_column_behavior not in ("drop", "error", "fill"):
            raise InvalidInput(f"unknown behaviour '{null_column_behavior}'")
        self.force_strategy, self.high_null_threshold = force_strategy, high_null_threshold
        self.skew_threshold, self.null_column_behavior = skew_threshold, null_column_behavior

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        height = df.count()
        nulls = df.agg(*[F.sum(F.when(q(c).isNull(), 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        stats = column_stats(df, cols, {"n": F.count, "mean": F.avg, "var": F.var_pop}, not_nan)
        third = df.agg(*[
            F.avg((d := not_nan(q(c)) - num(stats[c]["mean"] if stats[c]["mean"] is not None else 0.0)) * d * d).alias(f"m{i}") for i, c in enumerate(cols)
        ]).first()
        plan, gone = {}, []
        for i, c in enumerate(cols):
            if not stats[c]["n"]:
                if isinstance(self.force_strategy, (int, float)):
                    plan[c] = float(self.force_strategy)
                elif self.null_column_behavior == "error":
                    raise InvalidInput(f"column '{c}' has no value")
                elif self.null_column_behavior == "fill":
                    plan[c] = 0.0
                else:
                    gone.append(c)
            elif self.force_strategy is not None:
                plan[c] = self.force_strategy
            elif nulls[f"n{i}"] / height < self.high_null_threshold:
                var = stats[c]["var"]
                skew = third[f"m{i}"] / math.sqrt(var) ** 3 if var and math.isfinite(var) else 0.0
                plan[c] = "median" if abs(skew) > self.skew_threshold else "mean"
        kept = [c for c in df.columns if c not in gone]
        if not kept:
            raise InvalidInput("no column remains")
        first = Select(kept)
        if not plan:
            return Regrouped(first, {})
        inner = ColumnTransformer(_grouped(plan, SimpleImputer), "passthrough").fit(df.select(*[q(c) for c in kept]))
        return Regrouped(inner, {c: str(k) for c, k in plan.items()})


DECIMAL = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
NUMERIC = (T.NumericType,)


def looks_numeric(c):
    """A number or an ISO date or datetime, after trimming."""
    t = F.trim(c)
    day = F.when(t.rlike(ISO_DATE), F.substring(t, 1, 10)).try_cast("date")
    return t.rlike(DECIMAL) | day.isNotNull()


class AutoTypeDetector(Estimator):
    """Few-valued strings are one-hot encoded, many-valued ones hashed; numbers, numeric-looking strings and the rest pass.

    ``numeric_string_threshold`` is the share of (up to 1000) non-null values that must look numeric; which ones are
    looked at of more than 1000 is up to the storage order.
    """

    def __init__(self, cat_threshold: int = 20, hash_buckets: int = 100, numeric_string_threshold: float = 0.95):
        self.cat_threshold, self.hash_buckets, self.numeric_string_threshold = cat_threshold, hash_buckets, numeric_string_threshold

    def column_types(self) -> dict[str, str]:
        return dict(self.model.kinds)

    def detect(self, df) -> dict[str, str]:
        if not 0 <= self.numeric_string_threshold <= 1:
            raise InvalidInput("the threshold must lie in [0, 1]")
        if not df.columns:
            raise InvalidInput("the frame has no columns")
        strings = columns_of(df.schema, T.StringType)
        kinds = {f.name: "Numeric" if isinstance(f.dataType, NUMERIC) else "Passthrough" for f in df.schema.fields}
        if not strings:
            return kinds
        distinct = df.agg(*[F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(strings)]).first()
        for i, c in enumerate(strings):
            few = df.select(q(c).alias("v")).where("v is not null").limit(1000)
            n, good = few.agg(F.count("*"), F.sum(F.when(looks_numeric(F.col("v")), 1).otherwise(0))).first()
            if n and good / n >= self.numeric_string_threshold:
                kinds[c] = "NumericString"
            else:
                kinds[c] = "Categorical" if distinct[f"d{i}"] < self.cat_threshold else "HighCardinality"
        return kinds

    def _fit(self, df, target=None):
        kinds = self.detect(df)
        low = [c for c, k in kinds.items() if k == "Categorical"]
        high = [c for c, k in kinds.items() if k == "HighCardinality"]
        entries = []
        if low:
            entries.append(("categorical", OneHotEncoder(handle_unknown="ignore"), low))
        if high:
            entries.append(("high_cardinality", FeatureHasher(high, self.hash_buckets), high))
        model = Detected(ColumnTransformer(entries, "passthrough").fit(df) if entries else Select(df.columns), kinds)
        if not model.feature_names_out(df.schema):
            raise Computation("there is no output column")
        return model


class Detected(Regrouped):
    """Columns that only pass may be missing at transform."""

    def transform(self, df):
        inner = self.inner
        if isinstance(inner, Select):
            return Select([c for c in inner.columns if c in df.columns]).transform(df)
        return Parallel(inner.parts, [c for c in inner.passed if c in df.columns]).transform(df)


class Keep(Estimator):
    """Drops columns (none: the identity)."""

    def __init__(self, dropped: list[str] = ()):
        self.dropped = list(dropped)

    def _fit(self, df, target=None):
        for c in self.dropped:
            if c not in df.columns:
                raise InvalidInput(f"column '{c}' is missing")
        return Select([c for c in df.columns if c not in self.dropped])


class Encode(Estimator):
    """Target-encodes some columns; the target column serves the fit and does not come out."""

    supervised = True

    def __init__(self, columns):
        self.columns = columns

    def _fit(self, df, target):
        own = df.select(*[q(c) for c in self.columns], q(target).cast("double").alias(target))
        return TargetEncoder().fit(own, target)


@dataclass
class AutoPipelineConfig:
    target: str | None = None
    cat_threshold: int = 20
    hash_buckets: int = 100
    detect_datetime: bool = True
    remove_constant: bool = True
    remove_duplicates: bool = False
    normalize_strings: bool = False
    handle_unknown: str = "ignore"
    rare_category_grouper: dict | None = None  # settings of RareCategoryGrouper
    scaler: dict | None = None  # settings of AutoScaler
    imputer: dict | None = None  # settings of AutoImputer


@dataclass
class AutoModel(Model):
    inner: Model
    spec: SchemaSpec
    names: list[str]
    target: str | None
    steps: list[str] = field(default_factory=list)

    def transform(self, df):
        """The frozen schema, with or without the target, which is dropped; other columns are refused."""
        df = df.select(*[q(c) for c in df.columns if c != self.target])
        validate_schema(df, self.spec)
        extra = [c for c in df.columns if c not in self.names]
        if extra:
            raise InvalidInput(f"unexpected columns {extra}")
        return self.inner.transform(df.select(*[q(c) for c in self.names]))

    def outputs(self, schema):
        raise NotImplementedError("an automatic pipeline is applied step by step")

    def feature_names_out(self, names):
        return self.inner.feature_names_out(names)


class AutoPipeline(Estimator):
    """Profiles a frame and assembles a pipeline for it; the plan is in ``prepared_pipeline()``."""

    def __init__(self, config: AutoPipelineConfig | None = None):
        self.config = config or AutoPipelineConfig()
        self.pipeline: Pipeline | None = None

    @classmethod
    def from_inferred_schema(cls, df: DataFrame, **settings) -> AutoPipeline:
        """Settings by what the frame holds: imputing if a double column has nulls, scaling if there are double columns."""
        non_empty(df)
        numeric = columns_of(df.schema, T.DoubleType)
        config = AutoPipelineConfig(**settings)
        if numeric:
            config.scaler = config.scaler if config.scaler is not None else {}
            row = df.agg(*[F.max(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            if any(row) and config.imputer is None:
                config.imputer = {}
        return cls(config)

    def prepared_pipeline(self) -> Pipeline | None:
        return self.pipeline

    def is_fitted(self) -> bool:
        return self.model is not None

    def _fit(self, df, target=None):
        self.pipeline = None
        cfg = self.config
        target = target or cfg.target
        if cfg.hash_buckets < 1:
            raise InvalidInput("hash_buckets must be at least 1")
        if target is not None and (not target.strip() or target not in df.columns):
            raise InvalidInput(f"target column '{target}' is missing")
        non_empty(df)
        names = [c for c in df.columns if c != target]
        if not names:
            raise InvalidInput("there are no feature columns")
        features = df.select(*[q(c) for c in names])
        classes = False
        if target is not None and isinstance(df.schema[target].dataType, (T.IntegralType, T.BooleanType)):
            classes = len(df.select(q(target)).where(q(target).isNotNull()).distinct().limit(3).collect()) <= 2
        self.pipeline, supervised = self.assemble(features, target is not None and classes)
        if supervised:
            carried = df.select(*[q(c) for c in names], q(target).cast("double").alias("__target"))
            inner = _fit_supervised(self.pipeline, carried, "__target")
        else:
            inner = self.pipeline.fit(features)
        spec = SchemaSpec([Requirement("named", f.name, f.dataType) for f in features.schema.fields])
        return AutoModel(inner, spec, names, target, [n for n, _ in self.pipeline.steps])

    def assemble(self, features: DataFrame, binary_target: bool) -> tuple[Pipeline, bool]:
        cfg = self.config
        filled = features.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(features.columns)]).first()
        empty = [c for i, c in enumerate(features.columns) if not filled[f"c{i}"]]
        rest = [c for c in features.columns if c not in empty]
        if not rest:
            raise InvalidInput("every feature column is null")
        working = features.select(*[q(c) for c in rest])
        constant = ConstantColumnRemover().constants(working) if cfg.remove_constant else set()
        if len(constant) == len(rest):
            raise InvalidInput("every feature column is constant")
        planned = working.select(*[q(c) for c in rest if c not in constant])
        twins = DuplicateColumnRemover().duplicates(planned) if cfg.remove_duplicates else {}
        planned = planned.select(*[q(c) for c in planned.columns if c not in twins])
        strings = columns_of(planned.schema, T.StringType)
        cleaner = StringCleaner(strings, trim=True, collapse_internal_ws=True) if cfg.normalize_strings and strings else None
        seen = cleaner.fit_transform(planned) if cleaner else planned
        kinds = AutoTypeDetector(cfg.cat_threshold, cfg.hash_buckets).detect(seen)
        numeric = columns_of(planned.schema, T.DoubleType)
        dates = columns_of(planned.schema, *DATES) if cfg.detect_datetime else []
        low = [c for c in strings if kinds[c] == "Categorical"]
        high = [c for c in strings if kinds[c] == "HighCardinality"]
        encode = binary_target and bool(high)
        steps: list[tuple[str, Estimator]] = []
        if empty:
            steps.append(("drop_all_null", Keep(empty)))
        if constant:
            steps.append(("remove_constant", Keep([c for c in rest if c in constant])))
        if twins:
            steps.append(("remove_duplicates", Keep(list(twins))))
        if dates:
            steps += [("datetime_features", DatetimeFeatures(dates)), ("drop_datetime_sources", Keep(dates))]
        if cleaner:
            steps.append(("clean_strings", cleaner))
        if cfg.rare_category_grouper is not None and low + high:
            steps.append(("group_rare_categories", RareCategoryGrouper(low + high, **cfg.rare_category_grouper)))
        if encode:
            steps.append(("target_encode_high_cardinality", Encode(high)))
        entries = []
        inner = [("imputer", AutoImputer(**cfg.imputer))] if cfg.imputer is not None else []
        inner += [("scaler", AutoScaler(**cfg.scaler))] if cfg.scaler is not None else []
        if numeric and inner:
            entries.append(("numeric", Pipeline(inner), numeric))
        if low:
            entries.append(("categorical", OneHotEncoder(handle_unknown=cfg.handle_unknown), low))
        if high and not encode:
            entries.append(("high_cardinality", FeatureHasher(high, cfg.hash_buckets), high))
        if entries:
            steps.append(("column_transformers", ColumnTransformer(entries, "passthrough")))
        return Pipeline(steps or [("identity", Keep())]), encode


def _fit_supervised(pipeline: Pipeline, df: DataFrame, target: str) -> Model:
    """Fit a pipeline whose target column travels beside the features."""
    models = []
    for i, (name, est) in enumerate(pipeline.steps):
        own = df.select(*[q(c) for c in df.columns if c != target])
        try:
            model = est.fit(df if est.supervised else own, target if est.supervised else None)
        except QuernError as e:
            raise type(e)(f"step {i} '{name}': {e}") from e
        models.append((name, model))
        if i + 1 < len(pipeline.steps):
            moved = carried(df.select(F.struct(q(target)).alias("__row"), *[q(c) for c in own.columns]), model)
            df = moved.select(*[q(c) for c in moved.columns if c != "__row"], q("__row").getField(target).alias(target))
    pipeline.model = PipelineModel(models)
    return pipeline.model
