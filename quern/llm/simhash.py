"""SimHash near-duplicate groups over a byte-position inverted index with count filtering."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower_py, forget, settle
from quern.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SLICE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: bit i is set if it is set in over half of the shingles' XXH64.

    Null, empty and blank texts give 0; fewer words than ``width`` make one shingle.
    """
    words = WORDS.findall(ascii_lower_py(text)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        stop = min(n, at + _SLICE)
        parts = words[at : stop + width - 1]
        grams = map(" ".join, zip(*(parts[k:] for k in range(width)))) if n > 1 or len(words) >= width else [" ".join(parts)]
        h = np.fromiter((one(g, seed) for g in grams), np.uint64, stop - at)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            out = [fingerprint(t.as_py(), width, seed) for t in b.column(1)]
            fp = pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, fp bigint")


def _byte_sets(k: int) -> list[tuple[int, ...]]:
    """Sets of ``k`` byte positions such that any five of the eight positions hold one of them."""
    if k == 3:
        return [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
    if k == 5:
        return list(combinations(range(8), 5))
    raise ValueError("k must be 3 or 5")


def _mask(positions) -> int:
    m = sum(255 << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(_mask([p]))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(fps: DataFrame, bits: int = 3, k: int | None = None, hot: int = 1024) -> DataFrame:
    """Links between different fingerprints (column ``fp``, distinct) that differ in at most ``bits`` (<= 3) bits.

    At most three differing bits leave at least five of the eight bytes equal. The inverted index holds one posting
    per fingerprint and set of ``k`` byte positions, the sets being such that five equal bytes always include one of
    them (k=3: eight sets, 24-bit keys; k=5: all 56 sets, 40-bit keys). So a key stands for the first ``k`` hits of the
    count bound: a pair that does not share ``k`` bytes of some set cannot reach five, and is never formed. Postings of
    single bytes would give the same pairs after counting, but a 256th of all pairs before it. Pairs that meet in a
    posting list are tallied over all eight bytes: those sharing fewer than five go, the rest are verified on the
    differing bits.
    ``k=None`` takes 5 where the 24-bit lists would hold over 64 random fingerprints each; the links are the same.

    A posting list of over ``hot`` members is not paired. Its members differ in the other bytes only, so each is
    filed under every value within 1 and within 2 bit flips of it; two members are within 3 bits exactly if some value
    is within 1 of one and within 2 of the other. Members under a value with a 1-flip member are linked to the smallest
    such member: the same components, with a number of links that is linear in the list.
    """
    if bits > 3:
        raise ValueError("the count filter guarantees five equal bytes for at most 3 differing bits")
    if k is None:
        k = 3 if fps.count() <= 64 << 24 else 5
    sets = _byte_sets(k)
    posting = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("k")) for i, c in enumerate(sets)]))
    index = settle(fps.select("fp", posting.alias("p")).select("fp", "p.s", "p.k"))
    sizes = index.groupBy("s", "k").agg(F.count("*").alias("n")).where("n > 1")
    sizes = settle(sizes)
    busy = index.join(sizes, ["s", "k"])
    cool = settle(busy.where(F.col("n") <= hot).select("s", "k", "fp"))
    x, y = cool.alias("x"), cool.alias("y")
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.fp") < F.col("y.fp")))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= 5).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    if sizes.where(F.col("n") > hot).limit(1).count():
        pairs = pairs.union(_hot_links(busy.where(F.col("n") > hot).select("s", "fp"), sets, bits))
    return pairs.distinct()


def _hot_links(members: DataFrame, sets, bits: int) -> DataFrame:
    near, far = bits // 2, bits - bits // 2
    flips = []
    for c in sets:
        free = [1 << b if b < 63 else -(1 << 63) for b in range(64) if b // 8 not in c]
        masks = {0: 0}
        for r in range(1, far + 1):
            for combo in combinations(free, r):
                m = 0
                for f in combo:
                    m ^= f
                masks[m] = r
        flips.append([(m, r <= near) for m, r in masks.items()])
    spark = members.sparkSession
    rows = ",".join(f"{i}:{m}:{int(c)}" for i, f in enumerate(flips) for m, c in f)
    parts = F.split("x", ":")
    table = spark.range(1).select(F.explode(F.split(F.lit(rows), ",")).alias("x"))
    table = table.select(parts[0].cast("int").alias("s"), parts[1].cast("long").alias("m"), (parts[2] == "1").alias("one"))
    spread = members.join(F.broadcast(table), "s").select("s", "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "one")
    spread = settle(spread)
    hub = settle(spread.where("one").groupBy("s", "v").agg(F.min("fp").alias("hub")))
    return spread.join(hub, ["s", "v"]).where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))


def simhash_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bits: int = 3, hot: int = 1024
) -> DataFrame:
    """Near-duplicate groups of whole texts: ``key``, ``fp`` (long), ``node`` (the group's label) and ``component_id``.

    One row per input row. ``component_id`` is the smallest non-null key in the group (null if it has none). Equal
    fingerprints form one node, so exact copies never meet in pairs. Null, empty and blank texts have fingerprint 0 and
    are linked like any other; repeated rows and ties get equal values; an empty table gives no rows; other columns of
    ``df`` are not read.
    """
    fp = settle(fingerprints(df, key, text, width, seed))
    nodes = settle(fp.groupBy("fp").agg(F.min("key").alias("low")))
    cc = settle(connected_components(links(nodes.select("fp"), bits, hot=hot)))
    joined = nodes.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("node", F.coalesce("component", "fp"))
    joined = settle(joined.select("fp", "node", "low"))
    low = joined.groupBy("node").agg(F.min("low").alias("component_id"))
    linked = settle(joined.join(low, "node").select("fp", "node", "component_id"))
    forget(joined)
    return fp.join(linked, "fp").select(F.col("key").alias(key), "fp", "node", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
