"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, langid, licenses, linededup, media, packing, quality, sharding, simhash, urlfilter
from quern.llm.common import documents, fold, table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.encode("__kept", "UTF-8"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2), key="doc_id")
    return langid.identify(docs.select("doc_id", "text", held), model, keep=("held_out",))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(documents(spark, sf_dir))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


LABELS = 20_000


def labelled(docs: DataFrame, spark: SparkSession, sf_dir: str, most: int = LABELS) -> DataFrame:
    """Training rows: documents outside the held-out fold with their quality label, for at most ``most`` labels.

    The labels that a hash of their id puts first are taken. As their number is bounded, they are broadcast, and no text
    is shuffled to meet its label.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality in (0, 1)")
    labels = labels.where(fold(F.col("doc_id"), 5) != 0).distinct()
    share = most / max(1, labels.count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    first = labels.where(place < F.lit(int(1.5 * share * (1 << 20)) + 64)).orderBy(place, "doc_id", "quality").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(labelled(docs, spark, sf_dir), key="doc_id")
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    out = quality.score(docs.select("doc_id", "text", held), model, keep=("held_out",))
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.RULES).drop("aliases")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licences(documents(spark, sf_dir))
    return out.select("doc_id", F.array_join("families", ",").alias("licenses"), F.size("findings").cast("long").alias("n_findings"), "n_unknown")


SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def vocabulary() -> str:
    """The public vocabulary file, which is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_line_dedup, op3_language_id, op4_simhash_dedup, op5_url_filters,
        op6_quality_classifier, op7_decontamination, op8_license_scans, op9_sharding, op10_packing,
    )
}

def _part(url: str, pattern: str, group: int) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"regexp_extract({rest}, '{pattern}', {group})"


def _host(url: str) -> str:
    return f"translate({_part(url, '^[^/?#]*', 0)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _node(url: str) -> str:
    tail = _part(url, "^[^/?#]*([^#]*)", 1)
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || CASE WHEN {tail} = '' THEN '/' WHEN starts_with({tail}, '?') THEN '/' || {tail} ELSE {tail} END END"


def _target(tag: str, has: str, where: str) -> str:
    """What the first ``tag`` with ``has`` in it says at ``where``."""
    found = rf"(?is)^<{tag}\b[^>]*{where}"
    tags = rf"regexp_extract_all(html, '(?is)<{tag}\b[^>]*')"
    return f"regexp_extract(list_filter({tags}, lambda x: regexp_matches(x, '(?is){has}') AND regexp_matches(x, '{found}'))[1], '{found}', 1)"


_CANONICAL = _target("link", r"\brel\s*=\s*[\"'']?canonical\b", r"\bhref\s*=\s*[\"'']?([^\"''\s>]+)")
_REFRESH = _target("meta", r"\bhttp-equiv\s*=\s*[\"'']?refresh\b", r"\bcontent\s*=\s*[\"'']?[^>]*?url\s*=\s*[\"'']?([^\"''\s>]+)")
_TABLE9 = ",".join(map(str, sharding.lookup_table(SHARDS)))

SQL: dict[str, str] = {
    "op2_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
rep AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, rep.keeper IS NOT NULL AND rep.keeper <> doc_id AS lost FROM keyed LEFT JOIN rep USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op5_url_filters": f"""
WITH RECURSIVE q AS (SELECT page_id, url, {_host('url')} AS host, {_part('url', '^[^/?#]*([^?#]*)', 1)} AS path, {_node('url')} AS node,
  [{_CANONICAL}, {_REFRESH}] AS links FROM pages),
t AS (SELECT host, path, node AS a, replace(unnest(links), '&amp;', '&') AS t FROM q WHERE node IS NOT NULL),
u AS (SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
  ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || t END AS url FROM t WHERE t <> ''),
e0 AS (SELECT DISTINCT a, {_node('url')} AS b FROM u),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
j AS (SELECT x, {urlfilter.rules_sql("split_part(split_part(y, '/', 1), '?', 1)", "regexp_extract(y, '^[^/?#]*([^?#]*)', 1)", urlfilter.RULES, 'verdict')} AS v FROM r),
g AS (SELECT x, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS bad FROM j GROUP BY x),
m AS (SELECT q.*, {urlfilter.rules_sql('host', 'path', urlfilter.RULES, 'rule')} AS rule, {urlfilter.rules_sql('host', 'path', urlfilter.RULES, 'verdict')} AS own FROM q)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN g.bad THEN 'block' END, 'allow') AS verdict FROM m LEFT JOIN g ON m.node = g.x""",
    "op9_sharding": f"""
WITH t AS (SELECT string_split('{_TABLE9}', ',') AS owners),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS BIGINT) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owners[slot + 1], 2, '0') AS shard FROM d, t""",
}
