"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: by SimHash fingerprints, complete by prefix filtering."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import forget, settle
from quern.llm.components import connected_components
from quern.llm.decontam import _windows

WIDTH = 5
NUM, DEN = 4, 5  # the similarity, 0.8, as a fraction
_BITS = 22  # log2 of the buckets in which nodes are marked
_COUNTED = 23  # log2 of the buckets in which shingles are counted
_PART = 16  # log2 of the buckets whose counts travel together
_SHIFT = np.uint64(64 - _COUNTED)
_CHUNK = 1 << 18  # bytes of texts that are cut into words at once
_LONG = 1 << 16  # bytes from which a word is hashed by itself
_BLOCK = 128  # members of a family that meet others in one task
_MUL = 0x9E3779B97F4A7C15 | 1

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOW[65:91] += np.uint64(32)  # A-Z
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS:
        for m in (_MUL, pow(_MUL, -1, 1 << 64)):
            x = np.full(_CHUNK, m, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``raw[start:end]``, A-Z lower-cased: differences of one running polynomial, mixed."""
    power, back = _powers()
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOW[raw] * power[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * back[start]
    for i in np.flatnonzero(end - start > _LONG):
        h[i] = _long_word(raw[start[i] : end[i]])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _long_word(raw: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(raw.tobytes().translate(bytes(((_LOW - np.uint64(1)) & np.uint64(255)).astype(np.uint8)))))


def _mixed(h: np.uint64) -> np.uint64:
    x = np.array([h], np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29)))[0]


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie one behind another (``offsets``: their begins and the end), and the text of each."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~_SEP[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    word = inside[at]
    start, end = at[word], np.append(at, len(raw))[1:][word]
    return _word_hashes(raw, start, end), np.searchsorted(offsets, start, "right") - 1


def _one(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, cut at separators."""
    parts, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + _CHUNK)
        if stop < len(raw):
            seps = np.flatnonzero(_SEP[raw[at:stop]])
            if len(seps):
                stop = at + int(seps[-1]) + 1
            else:  # one word of over a chunk
                while stop < len(raw) and not _SEP[raw[stop]]:
                    stop += 1
                parts.append(np.array([_mixed(_long_word(raw[at:stop]))]))
                at = stop
                continue
        parts.append(_cut(raw[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array):
    """Sorted distinct 64-bit hashes of each whole text's shingles; fewer than five words make one, none make none."""
    column = column.fill_null("").cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        part = raw[offsets[at] : offsets[to]]
        if len(part) > _CHUNK:
            h = _one(part)
            owner = np.zeros(len(h), np.int64)
        else:
            h, owner = _cut(part, offsets[at : to + 1] - offsets[at])
        bounds = np.searchsorted(owner, np.arange(to - at + 1))
        wide = _windows(h) if len(h) >= WIDTH else h
        for i in range(to - at):
            a, b = bounds[i], bounds[i + 1]
            yield np.unique(wide[a : b - WIDTH + 1]) if b - a >= WIDTH else _windows(h[a:b]) if b > a else h[:0]
        at = to


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def _fingerprint(s: np.ndarray) -> int:
    """64-bit SimHash of a set: bit i is set if it is set in over half of the shingles' hashes; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), _CHUNK):
        ones += np.unpackbits(s[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(s)).view(">i8")[0])


def _first_pass(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two kinds of rows: ``key``, ``node`` and fingerprint ``fp`` of every text; ``part`` and ``counts``, in how many sets of a partition the
    shingles of each bucket are (255 at most: they only order shingles, any order is right)."""
    kind = df.schema[key].dataType

    def run(batches):
        counts, last, names = np.zeros(1 << _COUNTED, np.uint16), None, ["key", "node", "fp", "part", "counts"]
        for b in batches:
            nodes, fps = [], []
            for s in shingle_sets(b.column(1)):
                at = (s >> _SHIFT).astype(np.int64)
                counts[at] = np.minimum(counts[at], 254) + np.uint16(1)
                nodes.append(_node(s)), fps.append(_fingerprint(s))
            last = b.schema.field(0).type
            none = pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), *none], names=names)
        if last is not None:
            parts = counts.astype(np.uint8).reshape(-1, 1 << _PART)
            at = np.flatnonzero(parts.any(axis=1))
            packed = [zlib.compress(parts[i].tobytes(), 1) for i in at]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), last), *[pa.nulls(len(at), pa.int64())] * 2, pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return df.select(key, text).mapInArrow(run, f"key {kind.simpleString()}, node bigint, fp bigint, part int, counts binary")


def _ranks(counts: DataFrame) -> np.ndarray:
    """For each bucket eight times the binary logarithm of its count over all partitions, 255 at most."""

    def run(batches):
        sums: dict = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.frombuffer(zlib.decompress(packed), np.uint8)
                if part in sums:
                    sums[part] += n
                else:
                    sums[part] = n.astype(np.uint32)
        ranks = [np.minimum(255, 8 * np.log2(np.maximum(n, 1))).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["part", "ranks"])

    out = np.zeros((1 << _COUNTED - _PART, 1 << _PART), np.uint8)
    for r in counts.repartition("part").mapInArrow(run, "part int, ranks binary").collect():
        out[r.part] = np.frombuffer(r.ranks, np.uint8)
    return out.reshape(-1)


def _table(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = frame.toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def _sets(df: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """``node`` and ``set`` (its whole shingle set) of the wanted nodes, once each. A bit table marks them for the pass over the texts."""
    spark = df.sparkSession
    at, _ = _table(nodes.select(F.shiftrightunsigned("node", 64 - _BITS).alias("s")).distinct().select("s", F.lit(1)))
    marks = np.zeros(1 << _BITS, bool)
    marks[at] = True
    table = spark.sparkContext.broadcast(np.packbits(marks))

    def run(batches):
        marked, seen = np.unpackbits(table.value), set()
        def rows(found, sets):
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

        for b in batches:
            found, sets, size = [], [], 0
            for s in shingle_sets(b.column(0)):
                n = _node(s)
                if n not in seen and marked[(n & (1 << 64) - 1) >> (64 - _BITS)]:
                    seen.add(n)
                    found.append(n), sets.append(s.view(np.int64))
                    size += len(s)
                if size > 1 << 18:
                    yield rows(found, sets)
                    found, sets, size = [], [], 0
            yield rows(found, sets)

    sets = df.select(text).mapInArrow(run, "node bigint, set array<bigint>").join(nodes, "node", "left_semi")
    return settle(sets.groupBy("node").agg(F.first("set").alias("set")))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose whole sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(a, "a").join(b, "b")
    return settle(both.where((NUM + DEN) * F.size(F.array_intersect("x", "y")) >= NUM * (F.size("x") + F.size("y"))).select("a", "b"))


def _meet(x: DataFrame, y: DataFrame, when) -> DataFrame:
    """Pairs of postings of one shingle whose sets have sizes that allow them to be similar."""
    x, y = x.alias("x"), y.alias("y")
    size = DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n")
    return x.join(y, (F.col("x.g") == F.col("y.g")) & when & size)


def _ends() -> tuple:
    return F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")


def _tallied(met: DataFrame, busy_hot: DataFrame | None) -> DataFrame:
    """Pairs that share enough prefix shingles: those common to two sets are in both prefixes or behind one of them."""
    rest = F.greatest(*[F.ceil(F.lit(NUM) * F.col(n) / F.lit(DEN)) - 1 for n in ("na", "nb")])
    pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    extra = F.lit(0)
    if busy_hot is not None:  # shingles of lists that were not paired may be shared, too
        heat = settle(busy_hot.groupBy("node").agg(F.count("*").alias("k")))
        pairs = pairs.join(heat.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a", "left")
        pairs = pairs.join(heat.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b", "left")
        extra = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    return pairs.where((NUM + DEN) * (F.col("c") + extra + rest) >= NUM * (F.col("na") + F.col("nb"))).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    cc = settle(connected_components(links)).withColumnRenamed("component", "c")
    return members.join(cc, "node", "left").withColumn("c", F.coalesce("c", "node"))


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes whose fingerprints differ in at most 3 bits, by the inverted index over positional bytes,
    the tally and the check of bits of :mod:`quern.llm.simhash`. Nodes of one fingerprint are paired with its smallest
    node only, and that stands for them towards other fingerprints."""
    hubs = settle(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("m")))
    same = nodes.join(hubs.where("m > 1"), "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = settle(simhash.links(hubs.select("fp")))
    ends = [hubs.select(F.col("fp").alias(e), F.col("hub").alias(f"{e}_hub")) for e in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("a_hub", "b_hub").alias("a"), F.greatest("a_hub", "b_hub").alias("b"))
    return settle(same.union(near))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ends the links known so far do not join already."""
    cc = settle(connected_components(known))
    for e in "ab":
        pairs = pairs.join(cc.select(F.col("node").alias(e), F.col("component").alias(f"c{e}")), e, "left")
    return settle(pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def links(df: DataFrame, ranks: np.ndarray, nodes: DataFrame, text: str = "text", hot: int = 64) -> DataFrame:
    """Links ``a``, ``b`` of nodes (distinct shingle sets) that have the components of all pairs of similarity >= 0.8.

    Near fingerprints (``nodes``: ``node`` and ``fp``) make the first pairs, verified on whole sets. As 3 bits reach but some
    of the similar pairs, an index of shingles finds the others; those that fingerprints have joined are not verified again.

    Two sets of that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of each in any one order. The
    order takes rare shingles first, by the ``ranks`` of :func:`_ranks`, so that common passages are not met in lists. Pairs that
    meet are filtered by their sizes and the number of such shingles they share, and verified on whole sets.

    Lists of over ``hot`` members are not paired: see :func:`_hot_links`.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(ranks)

    def run(batches):
        rank = table.value
        def rows(cols):
            kinds = (pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=["g", "node", "n"])

        for b in batches:
            cols: list[list] = [[np.zeros(0, np.int64)] for _ in range(3)]
            size = 0
            for s in shingle_sets(b.column(0)):
                if size > 1 << 17:
                    yield rows(cols)
                    cols, size = [[np.zeros(0, np.int64)] for _ in range(3)], 0
                n = len(s)
                if n:
                    p = n - (NUM * n + DEN - 1) // DEN + 1
                    s_low = s[np.argsort(rank[(s >> _SHIFT).astype(np.int64)], kind="stable")[:p]]
                    for c, v in zip(cols, (s_low.view(np.int64), np.full(p, _node(s)), np.full(p, n)), strict=True):
                        c.append(v)
                    size += p
            yield rows(cols)

    index = settle(df.select(text).mapInArrow(run, "g bigint, node bigint, n int"))
    dealt = index.repartition("g")  # one shuffle for the lists and their members
    shared = dealt.groupBy("g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("g")
    busy = settle(dealt.join(shared.hint("merge"), "g").distinct())
    forget(index)
    sizes = settle(busy.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("g"))
    heated = sizes.limit(1).count() > 0
    many = settle(busy.join(sizes, "g")) if heated else None
    cool = settle(busy.join(sizes, "g", "left_anti")) if heated else busy
    pairs = settle(_tallied(_meet(cool, cool, F.col("x.node") < F.col("y.node")), many))
    forget(cool)
    close = _near_fingerprints(nodes)
    wanted = pairs.union(close).select(F.explode(F.array("a", "b")).alias("node"))
    wanted = settle((wanted.union(many.select("node")) if heated else wanted).distinct())
    sets = _sets(df, text, wanted)
    out = _verified(sets, close)
    rest = _apart(pairs, out)
    out = settle(out.union(_verified(sets, rest)))
    if heated:
        out = settle(out.union(_hot_links(many, sets, out, hot)).distinct())
    for used in (pairs, close, rest, wanted, sets, busy, sizes, many):
        if used is not None:
            forget(used)
    return out


def _hot_links(many: DataFrame, sets: DataFrame, known: DataFrame, hot: int) -> DataFrame:
    """Links among the members of long lists (``g``, ``node``, ``n``), which have the components of all that there are.

    Two members that are similar share shingles that at least two members hold, so a member with fewer of those than
    0.8 of its shingles has no link to another and goes; most documents that share but a passage do. In each list the
    member with most of those shingles, the one that lies in the middle of near copies, is the hub; lists with one hub
    are one family, all members of which are verified against it. Members that are not in their family's largest
    component after that, and have shared shingles enough for some other member, are compared with the family's members
    in blocks of about ``_BLOCK`` by ``_BLOCK``: no pair leaves a task but the links found.
    """
    members = settle(many.select("node", "n").distinct())
    hashes = sets.join(members.select("node"), "node", "left_semi").select("node", F.explode("set").alias("s"))
    shared = hashes.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("s")
    held = settle(hashes.join(shared.hint("merge"), "s").groupBy("node").agg(F.count("*").cast("int").alias("c")))
    able = settle(members.join(held, "node").where(DEN * F.col("c") >= NUM * F.col("n")))
    lists = many.select("g", "node").join(able, "node")
    best = lists.groupBy("g").agg(F.max(F.struct("c", "n", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    family = settle(lists.join(best.select("g", F.col("hub.node").alias("hub")), "g").select("hub", "node", "n", "c").distinct())
    spokes = family.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    out = _verified(sets, settle(spokes))
    cc = settle(connected_components(known.union(out))).withColumnRenamed("component", "o")
    placed = settle(family.join(cc, "node", "left").withColumn("o", F.coalesce("o", "node")))
    per = settle(placed.groupBy("hub", "o").agg(F.count("*").alias("k"), F.min("n").alias("low")))
    main = per.groupBy("hub").agg(F.max(F.struct("k", "o")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("cs"), F.min("low").alias("low")).where("cs > 1")
    main = settle(main.select("hub", F.col("top.o").alias("main"), "m", "low"))
    if not main.limit(1).count():
        return out
    all_of = placed.join(main, "hub")
    need = lambda x, y: (NUM + DEN) * F.col("c") >= NUM * (F.col(x) + F.col(y))
    open_ = all_of.where(F.col("o") != F.col("main")).where(need("n", "low"))
    blocks = F.ceil(F.col("m") / _BLOCK).cast("int")
    deal = lambda x: F.pmod(F.xxhash64(x), blocks).cast("int")
    one = open_.select("hub", deal("node").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(0).alias("side"), "node", "o")
    busy = open_.select("hub", deal("node").alias("i")).distinct()
    two = all_of.select("hub", deal("node").alias("j"), "node", "o").join(busy, "hub").select("hub", "i", "j", F.lit(1).alias("side"), "node", "o")
    met = one.union(two).join(sets, "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")
    found = met.select("hub", "i", "j", "side", "node", "o", "set").mapInArrow(_compare, "a bigint, b bigint")
    more = settle(found.distinct())
    for used in (members, held, able, family, cc, placed, per, main):
        forget(used)
    return out.union(more)


def _compare(batches):
    """Links between the rows of side 0 and those of side 1 of each block, which lie together, side 0 first; of members of one component none is looked for."""
    at, queries, where = None, [], None
    for b in batches:
        a, c = [], []
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        sides, nodes, comps = (b.column(i).to_pylist() for i in (3, 4, 5))
        for i, k in enumerate(keys):
            if k != at:
                at, queries, where = k, [], None
            s = b.column(6)[i].values.to_numpy()
            if sides[i] == 0:
                queries.append((nodes[i], comps[i], s))
                continue
            if where is None and queries:  # which query holds each shingle
                all_s, owner = np.concatenate([q[2] for q in queries]), np.repeat(np.arange(len(queries)), [len(q[2]) for q in queries])
                order = np.argsort(all_s, kind="stable")
                where, owner, size = all_s[order], owner[order], np.array([len(q[2]) for q in queries])
                comp = np.array([q[1] for q in queries])
            if not queries:
                continue
            lo, hi = np.searchsorted(where, s, "left"), np.searchsorted(where, s, "right")
            n = hi - lo
            hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.bincount(owner[hit], minlength=len(queries))
            for q in np.flatnonzero(((NUM + DEN) * both >= NUM * (size + len(s))) & (comp != comps[i])).tolist():
                a.append(min(queries[q][0], nodes[i])), c.append(max(queries[q][0], nodes[i]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = 64) -> DataFrame:
    """Groups of texts of five-word similarity >= 0.8: ``key``, ``node`` (of the text's shingle set) and ``component_id``, the group's smallest key.

    One row per input row. Words are those of :mod:`quern.llm.simhash`. Null, empty and blank texts are one group; texts of
    fewer than five words have one shingle; very long ones are read whole. Equal sets (ties, repeated rows) are one node,
    so that exact copies never meet in pairs. Other columns are not read; an empty table gives no rows.
    """
    first = settle(_first_pass(df, key, text))
    rows = settle(first.where("part is null").select("key", "node", "fp"))
    ranks = _ranks(first.where("part is not null").select("part", "counts"))
    forget(first)
    nodes = settle(rows.groupBy("node").agg(F.min("key").alias("low"), F.first("fp").alias("fp")))
    found = links(df, ranks, nodes.where("node <> 0").select("node", "fp"), text, hot)
    nodes = settle(_labelled(nodes, found))
    low = nodes.groupBy("c").agg(F.min("low").alias("component_id"))
    named = settle(nodes.join(low, "c").select("node", "component_id"))
    return rows.join(named, "node").select(F.col("key").alias(key), "node", "component_id")
