"""Corpus-wide line deduplication behind a once-seen and a twice-seen Bloom filter."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower_py, forget, settle

STRIP = " \t\n\x0b\x0c\r"
_SEGMENT = 1 << 13  # bytes of a filter that travel together
_LEAST_LOG2, _MOST_LOG2 = 20, 29  # a broadcast filter takes at most 64 MiB
_MARKS_LOG2 = 28  # most bits of the table of documents that lose lines: 32 MiB


def line_key(line: str) -> str:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return ascii_lower_py(line.strip(STRIP))


def _long_keys(text: str | None, least: int) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    if text:
        for i, line in enumerate(text.split("\n")):
            if len(line) >= least and len(k := line.strip(STRIP)) >= least:
                out.setdefault(ascii_lower_py(k), []).append(i)
    return out


def _slots(keys, log2_bits: int) -> np.ndarray:
    """Two bit positions per key, both in one segment."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    seg = (h >> np.uint64(32)) % np.uint64(max(1, (1 << log2_bits) // (_SEGMENT * 8)))
    lo = np.uint64(min(1 << log2_bits, _SEGMENT * 8) - 1)
    base = seg * np.uint64(_SEGMENT * 8)
    return np.stack([base + (h & lo), base + ((h >> np.uint64(16)) & lo)], axis=1).astype(np.int64)


class _Pair:
    """The two filters: bits of keys seen in one document, bits of keys suspected in two."""

    def __init__(self, log2_bits: int):
        self.bits, self.log2 = max(1 << log2_bits, _SEGMENT * 8), log2_bits
        self.once = np.zeros(self.bits // 8, np.uint8)
        self.twice = np.zeros(self.bits // 8, np.uint8)

    def add(self, slots: np.ndarray) -> None:
        """Keys of one document, each once."""
        byte, bit = slots >> 3, (1 << (slots & 7)).astype(np.uint8)
        seen = ((self.once[byte] & bit) != 0).all(axis=1)
        if seen.any():
            np.bitwise_or.at(self.twice, byte[seen].ravel(), bit[seen].ravel())
        np.bitwise_or.at(self.once, byte.ravel(), bit.ravel())

    def segments(self):
        for at in range(0, len(self.once), _SEGMENT):
            once = self.once[at : at + _SEGMENT]
            if once.any():
                yield at // _SEGMENT, zlib.compress(once, 1), zlib.compress(self.twice[at : at + _SEGMENT], 1)


def filter_bits(df: DataFrame, text: str) -> int:
    """log2 of the bits of each filter: 16 for every line of the table, in bounds that a broadcast bears."""
    lines = df.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1).alias("n")).first().n or 0
    return min(_MOST_LOG2, max(_LEAST_LOG2, int(16 * lines).bit_length()))


def _build(df: DataFrame, text: str, least: int, log2_bits: int) -> np.ndarray:
    """The twice-seen filter of the whole table: every key of two or more documents has both its bits set.

    Each task fills its own pair of filters of fixed size and ships the touched 8 KiB segments, compressed. Segments
    merge pairwise by ``twice = twice1 | twice2 | once1 & once2``; that is associative, so each number of partitions
    gives a filter without false negatives. They merge in a tree: a segment of up to 256 tasks first, then those results.
    """

    def fill(batches):
        from pyspark import TaskContext

        pair = _Pair(log2_bits)
        for b in batches:
            for t in b.column(0):
                if keys := _long_keys(t.as_py(), least):
                    pair.add(_slots(keys, log2_bits))
        rows = list(pair.segments())
        yield _segments([(TaskContext.get().partitionId(), *r) for r in rows])

    def merge(batches):
        held: dict[tuple, tuple] = {}
        for b in batches:
            for p, s, once, twice in zip(*(c.to_pylist() for c in b.columns), strict=True):
                o, w = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                if (p, s) in held:
                    q, r = held[p, s]
                    held[p, s] = q | o, r | w | (q & o)
                else:
                    held[p, s] = o, w
        yield _segments([(*k, *(zlib.compress(x, 1) for x in v)) for k, v in held.items()])

    kind = "part int, segment int, once binary, twice binary"
    parts = df.select(text).mapInArrow(fill, kind)
    some = parts.withColumn("part", F.shiftright("part", 8)).repartition("part", "segment").mapInArrow(merge, kind)
    merged = some.withColumn("part", F.lit(0)).repartition("segment").mapInArrow(merge, kind)
    twice = np.zeros(max(1 << log2_bits, _SEGMENT * 8) // 8, np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():  # bounded by the filter's fixed size
        twice[row.segment * _SEGMENT :][:_SEGMENT] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return twice


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "segment", "once", "twice"])


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with its columns called ``c0``, ``c1`` and so on, so that what is added clashes with none, and ``doc``, ``body``, ``th``, ``len``."""
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = rows.withColumns({"doc": F.col(f"c{df.columns.index(key)}"), "body": F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit(""))})
    return rows.withColumns({"th": F.xxhash64("body"), "len": F.length("body")})


def duplicate_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, log2_bits: int | None = None
) -> DataFrame:
    """Lines to drop, one row per document text that loses any: ``doc`` (its ``key``), ``th`` and ``len`` (hash and
    length of the text), and ``drop`` (for every line up to the last one to drop, whether it goes).

    A document is a distinct ``key``, of any orderable type (all null keys are one document, smaller than any other).
    """
    spark = df.sparkSession
    slim = _named(df.select(key, text), key, text).select("doc", "body", "th", "len")
    log2 = filter_bits(slim, "body") if log2_bits is None else log2_bits
    twice = spark.sparkContext.broadcast(_build(slim, "body", least_chars, log2))

    def suspects(batches):
        filt = twice.value
        for b in batches:
            digest, row, at = [], [], []
            for i, t in enumerate(b.column(1)):
                keys = _long_keys(t.as_py(), least_chars)
                if not keys:
                    continue
                s = _slots(keys, log2)
                hit = ((filt[s >> 3] & (1 << (s & 7)).astype(np.uint8)) != 0).all(axis=1)
                for k, yes in zip(keys, hit.tolist(), strict=True):
                    if yes:
                        digest.append(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                        row.append(i), at.append(keys[k])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), *(b.column(c).take(take) for c in (0, 2, 3)), pa.array(at, pa.list_(pa.int32()))], names=["digest", "doc", "th", "len", "at"]
            )

    kind = slim.schema["doc"].dataType.simpleString()
    seen = settle(slim.mapInArrow(suspects, f"digest binary, doc {kind}, th bigint, len int, at array<int>"))
    per_doc = seen.select("digest", "doc").distinct()
    counted = per_doc.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
    repeated = settle(counted.where(F.col("docs") >= least_docs).select("digest", "keeper"))
    lost = seen.join(repeated, "digest").where(~F.col("doc").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc", "th", "len").agg(F.flatten(F.collect_list("at")).alias("at"))

    def marked(batches):
        for b in batches:
            masks = []
            for at in b.column(3):
                i = np.array(at.as_py())
                mask = np.zeros(i.max() + 1, bool)
                mask[i] = True
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks, pa.list_(pa.bool_()))], names=["doc", "th", "len", "drop"])

    out = settle(lost.mapInArrow(marked, f"doc {kind}, th bigint, len int, drop array<boolean>"))
    forget(seen)
    forget(repeated)
    return out


def _marks(drops: DataFrame) -> tuple[DataFrame, Column, Column]:
    """A bit table of the texts in ``drops``: (segment, longs) rows of bounded size, and the segment and test of a row's hash.

    It has 16 bits for each text, up to 2^28 bits in all: beyond some tens of millions of texts that lose lines, more and
    more of the others are taken along to the join, which knows them exactly.
    """
    bits = min(_MARKS_LOG2, max(19, int(16 * drops.count()).bit_length()))
    h = F.xxhash64("th", "len")
    segment = F.shiftrightunsigned(h, 45).bitwiseAND(F.lit((1 << (bits - 19)) - 1)).cast("int")
    word, bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << 13) - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = drops.select(segment.alias("s"), word.alias("w"), one.alias("b")).groupBy("s", "w").agg(F.bit_or("b").alias("b"))

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, w, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(s, np.zeros(1 << 13, np.int64))[w] = b
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["s", "bits"])

    table = settle(words.repartition("s").mapInArrow(join, "s int, bits array<bigint>"))
    return table, segment, F.coalesce(F.get("bits", word).bitwiseAND(one) != 0, F.lit(False))


def dedup_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, log2_bits: int | None = None, out: str = "__kept"
) -> DataFrame:
    """``df`` with ``out`` (the text without repeated lines), ``__lines`` and ``__dropped`` (their numbers).

    Texts are split at ``\\n`` (null or empty: one empty line). A line whose key (see :func:`line_key`) has at least
    ``least_chars`` code points and stands in at least ``least_docs`` documents is dropped everywhere except in the
    largest ``key`` that holds it, where all its lines stay. The other lines stay, joined by ``\\n``.

    Two Bloom filters (``2 ** log2_bits`` bits each; None: by the number of lines, at most 64 MiB) pass over all
    documents; only lines that the twice-seen filter suspects are shuffled, as 128-bit digests, to be counted exactly. As
    a filter fills, more lines are suspected, never fewer: its size moves costs, not results. Only texts that a bit
    table marks as losing lines are shuffled to meet the lines' positions; all others pass by.

    Rows with equal keys are one document for the count, and each row's lines are judged by that key; a null key is one
    document, smaller than any other. Every row of ``df`` comes back once with all its columns, whatever their names
    (only ones called ``out``, ``__lines`` or ``__dropped`` are replaced); texts of any length are read whole; an empty
    table gives none.
    """
    drops = duplicate_lines(df, key, text, least_chars, least_docs, log2_bits)
    table, segment, mark = _marks(drops)
    rows = _named(df, key, text)
    flagged = rows.join(F.broadcast(table), segment == F.col("s"), "left").withColumn("mark", mark).drop("s", "bits")
    n = (F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"))) + 1).cast("long")
    new = (out, "__lines", "__dropped")
    mine = {f"c{i}": c for i, c in enumerate(df.columns) if c not in new}
    calm = flagged.where("not mark").select(*mine, F.col("body").alias("x0"), n.alias("x1"), F.lit(0).cast("long").alias("x2"))
    d = drops.select(F.col("doc").alias("d"), F.col("th").alias("t"), F.col("len").alias("l"), "drop")
    met = flagged.where("mark").join(d, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("len") == F.col("l")), "left")
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda _, i: ~F.coalesce(F.get("drop", i), F.lit(False))), "\n")
    gone = F.coalesce(F.size(F.filter("drop", lambda x: x)), F.lit(0)).cast("long")
    lossy = met.select(*mine, F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept).alias("x0"), n.alias("x1"), gone.alias("x2"))
    return calm.union(lossy).toDF(*mine.values(), *new)
