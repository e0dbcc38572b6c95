import duckdb
import pytest


@pytest.fixture(scope="session")
def docs(sf_dir):
    """(doc_id, text, lang) of the smallest table."""
    return duckdb.sql(f"select doc_id, text, lang from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta"
    long = "\n".join(f"line number {i} of a very long text {i * 7}" for i in range(40_000))
    rows = [
        (1, "en", None), (2, "en", ""), (3, None, " \t\n"), (4, "fr", "été à la plage, où les élèves étaient"), (5, "en", words), (5, "en", words),
        (6, None, words + "\nshared line that many documents hold"), (7, "en", "shared line that many documents hold"),
        (None, "en", "shared line that many documents hold"), (8, "en", "SHARED line that many documents hold  \nx"), (9, "en", long),
        (10, "en", "1234 !!! \x00 İ ẞ \U0001f600 'tis don't"), (None, None, None), (11, "zh", "漢字仮名交じり文"), (12, "en", words.replace("eta", "eta x")),
    ]
    df = spark.createDataFrame([(a, c, b) for a, b, c in rows], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    clash = {c: F.lit("clash") for c in ("key", "fp", "node", "score", "piece", "length", "line", "slot", "shard", "quality_score", "__kept", "text_1", "rank", "pid", "h")}
    return df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), **clash})


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
