"""Fitted models on streams: stateless models are projections, so a stream takes them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.base import Model
from quern.errors import InvalidInput
from quern.operators.timeseries import EwmaModel, Series


def transform_stream(model: Model, stream: DataFrame) -> DataFrame:
    """Apply a fitted model to a streaming frame; models that need row order are refused."""
    if not stream.isStreaming:
        raise InvalidInput("the frame is not a stream")
    if isinstance(model, (Series, EwmaModel)):
        raise InvalidInput("time-series models need an ordered table, not a stream")
    return model.transform(stream)


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
