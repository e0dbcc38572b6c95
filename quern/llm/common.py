"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship as _ship

__all__ = ["ascii_lower", "ascii_lower_py", "documents", "fold", "fold_py", "forget", "settle", "shared_dir", "ship", "table"]

_OWN_DIR: str | None = None
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITTEN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the executors. Whole texts are long rows: where the session has Spark's own number of rows a batch
    (10,000), 1,000 go to Python at once, so that a batch stays a few megabytes on both sides."""
    _ship(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset: a temporary one for a local master, which
    is one machine; an error on a cluster, whose executors could not read it."""
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="quern-")
    return _OWN_DIR


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    This cuts the lineage like ``checkpoint()``, but runs the plan once only, and the rows survive the loss of any
    executor. Tables are removed when the driver ends; :func:`forget` removes one earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again."""
    spark = df.sparkSession
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for item in [x for x in _WRITTEN if any(f.endswith(x[1].rsplit("/", 1)[1]) for f in files)]:
        _delete(*item)
        _WRITTEN.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: whoever owns the shared folder cleans it
        pass


@atexit.register
def _forget_all() -> None:
    for item in _WRITTEN:
        if item[0].sparkContext._jsc is not None and item[0].sparkContext._jsc.sc().isStopped() is False:
            _delete(*item)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change letters outside ASCII)."""
    return F.translate(col, UPPER, LOWER)


_CAPS = re.compile("[A-Z]+")


def ascii_lower_py(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _CAPS.sub(lambda m: m.group().lower(), text)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the text ``null``)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null"))) % modulus


def fold_py(key, modulus: int) -> int:
    return zlib.crc32(("null" if key is None else str(key)).encode()) % modulus
