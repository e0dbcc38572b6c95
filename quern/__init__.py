"""Feature engineering on Spark frames: fit with a few aggregates, transform with one projection."""

from quern.errors import Computation, InvalidInput, NotFitted
from quern.functions.exprs import clamp, fdiv, finite, flog, q
from quern.operators.clean import StringCleaner
from quern.operators.encoders import (
    BinaryEncoder,
    CountEncoder,
    CyclicalEncoder,
    FeatureHasher,
    FrequencyEncoder,
    LabelEncoder,
    LeaveOneOutEncoder,
    OneHotEncoder,
    OrdinalEncoder,
    RareCategoryGrouper,
    TargetEncoder,
)
from quern.operators.generate import DatetimeFeatures, HolidayEncoder, InteractionFeatures, PolynomialFeatures, RatioFeatures, TimeSince
from quern.operators.missing import ConstantColumnRemover, DuplicateColumnRemover, MissingIndicator, SimpleImputer, VarianceThreshold
from quern.operators.nonlinear import KBinsDiscretizer, LogTransformer, PowerTransformer, QuantileTransformer
from quern.operators.scalers import Binarizer, ClipMethod, MaxAbsScaler, MinMaxScaler, Normalizer, OutlierClipper, RobustScaler, StandardScaler, Winsorizer
from quern.operators.selection import (
    CorrelationThreshold,
    MutualInformationSelector,
    SelectKBest,
    SelectPercentile,
    f_classif,
    f_regression,
)
from quern.operators.text import CharacterNGramVectorizer, CountVectorizer, TFIDFVectorizer
from quern.operators.timeseries import Difference, ExpandingAggregator, ExponentiallyWeightedMovingAverage, Lagger, RollingAggregator
from quern.plans.auto import AutoImputer, AutoPipeline, AutoPipelineConfig, AutoScaler, AutoTypeDetector
from quern.plans.compose import CachedPipeline, ColumnTransformer, ConditionalPipeline, FeatureUnion, Pipeline
from quern.plans.report import DataQualityReport
from quern.schema import SchemaSpec, check_schema, validate_schema
from quern.session import configure

__all__ = [n for n in dir() if not n.startswith("_")]
