"""A training-data pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; the frame is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``docs``; what a stage decides takes effect on its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, linededup, neardup, packing, quality
from quern.llm.common import documents, settle, ship, table
from quern.llm.queries import labelled, vocabulary

LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3, judged by a model learned from ``labels``.

    Null and empty texts get the score of no features, a very long text is judged whole, equal texts (repeated rows too)
    alike; extra columns of any name stay; an empty table gives none. Without labels of both kinds the score is the
    share of label 1 (0.5 without any)."""
    ship(spark)
    model = quality.fit(labelled(docs, spark, sf_dir), key="doc_id")
    names = [f"c{i}" for i in range(len(docs.columns))]  # extra columns may bear any name
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    scored = quality.score(rows.select(*names), model, key=names[0], text=text, keep=tuple(names[1:]))
    return scored.where(F.col("quality_score") >= LEAST_QUALITY).select(*names).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents repeat; a document all of whose lines go keeps an empty text.

    Null texts stay null; empty texts, rows without an id, repeated rows and extra columns of any name stay as they
    are; very long texts are read whole; an empty table gives none."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = linededup.dedup_lines(docs.toDF(*names), at["doc_id"], at["text"])
    null = F.col(at["text"]).isNull()
    new = {at["text"]: F.when(null, None).otherwise(F.col("__kept"))}
    if "n_chars" in at:
        new[at["n_chars"]] = F.when(null, F.col(at["n_chars"])).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return out.withColumns(new).select(*names).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Rows that share this id leave one of them; a group without any id leaves one of its rows. Null, empty and blank
    texts are one group; very long texts are compared whole; extra columns of any name stay; an empty table gives none."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    marked = docs.toDF(*names).withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("th").alias("th"))
    groups = neardup.near_groups(marked.select(row.alias("row"), F.col(text).alias("text")), key="row")
    first = groups.where(F.col("row") == F.col("component_id")).groupBy("row").agg(F.count("*").alias("n"))
    first = settle(first.select(F.col("row.id").alias("id"), F.col("row.th").alias("h"), "n"))
    kept = marked.join(first, F.col(key).eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left_semi")
    if first.where("n > 1").limit(1).count():  # some rows are the same in id and text
        kept = kept.dropDuplicates([key, "th"])
    return kept.select(*names).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; rows with equal ids (null ones too) stay or go together; very long texts are read
    whole; extra columns of any name stay; an empty table gives none."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), key=key, text=text)
    bad = settle(found.select(F.col(key).alias("bad")).distinct())
    return rows.join(bad, F.col(key).eqNullSafe(F.col("bad")), "left_anti").toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens.

    A null or empty text is a document of one token; repeated rows and rows without an id are packed each for itself;
    longer texts are cut, none is dropped; other columns are not read; an empty table gives no pieces."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
# A learned classifier, XXH64 and a byte-pair vocabulary are beyond SQL: tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
