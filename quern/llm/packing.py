"""Best-fit packing of token sequences by linear grouping of the length histogram."""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import settle

# What both Python's re and the tokenizer's own normaliser and splitter see alike.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class WordTokenizer:
    """Ids of whole texts under ``word_bpe_49k.json``, word by word.

    The vocabulary never merges across words, so that a word's ids can be remembered (up to ``size`` words). New words
    are encoded together; the tokens that end a word tell them apart. Texts with characters on which normalisers differ,
    or with a special token's text, go through the tokenizer as a whole.
    """

    def __init__(self, path: str, size: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.size = size

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _SPLIT.findall(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            new = list({w for w, f in zip(words, found, strict=True) if f is None})
            if len(self.known) + len(new) > self.size:
                self.known.clear()
                new = list(set(words))
            self._learn(new)
            found = list(map(self.known.__getitem__, words))
        return b"".join(found)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            raw = ids.tobytes()
            self.known.update(zip(words, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        else:
            for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This process's tokenizer: a worker that runs several tasks keeps the words it knows."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, and its place among pieces of one
    length: ``pid`` (partition) and ``nth`` (of that length there)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        tok, pid, nth = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = int(end).to_bytes(4, "little")
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tok.ids(t.as_py()) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for c, v in zip(cols, (i, k, at // 4, n, zlib.crc32(part), int(nth[n])), strict=True):
                        c.append(v)
                    nth[n] += 1
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([pid] * len(cols[0]), pa.int32())],
                names=["key", "piece", "start", "length", "ids_crc32", "nth", "pid"],
            )

    return df.select(key, text).mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, pid int")


@dataclass
class Bins:
    """``count`` sequences that all hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def plan(counts: dict[int, int], capacity: int = 2048, groups: int = 192, small: float = 0.35, gap: float = 1 / 16) -> list[Bins]:
    """Pack a histogram of lengths (1 to ``capacity``) into as few sequences as it can; every piece is placed.

    1. Lengths over ``small * capacity`` are large. In descending order they are cut into groups of equal cardinality
       (``groups`` of them, or twice the root of their number if that is less), and each is rounded up to its group's largest.
    2. The fractional configuration problem over these few sizes is solved by column generation. The small pieces count
       as a fluid that must find room too: in what a configuration leaves over, if that is at least ``gap * capacity``,
       or in sequences of its own. So large pieces are not packed so tightly that the room left fits nothing.
    3. The integer part of the solution is taken. Actual pieces, with their actual lengths, take the places of their
       group, the longest ones together; a configuration's sequences keep these pieces to the end.
    4. Small pieces, and those few large ones that the integer part leaves (fewer than configurations), go best-fit, the
       longest first, into what room is left, then into new sequences.

    All work is on runs of equal pieces: it depends on ``capacity`` and ``groups``, not on the number of pieces.
    """
    bins, rest = configured(counts, capacity, groups, small, gap)
    return _best_fit(bins, rest, capacity)


def configured(counts: dict[int, int], capacity: int, groups: int, small: float, gap: float) -> tuple[list[Bins], dict[int, int]]:
    """Steps 1 to 3 of :func:`plan`: sequences of large pieces, and the histogram of the pieces that have no place yet."""
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is outside 1 to capacity")
    rest = {n: c for n, c in counts.items() if c}
    bins = [Bins((capacity,), rest.pop(capacity))] if capacity in rest else []
    runs = _groups({n: c for n, c in rest.items() if n > small * capacity}, groups)
    fluid = sum(n * c for n, c in rest.items() if n <= small * capacity)
    for pattern, times in _configurations([r[0][0] for r in runs], [sum(c for _, c in r) for r in runs], fluid, capacity, int(gap * capacity)):
        slots = [_take(runs[i], times) for i, a in enumerate(pattern) for _ in range(a)]
        while times:
            step = min(s[0][1] for s in slots)
            bins.append(Bins(tuple(s[0][0] for s in slots), step))
            for s in slots:
                rest[s[0][0]] -= step
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
            times -= step
    return bins, {n: c for n, c in rest.items() if c}


def _groups(large: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality, as runs ``[length, count]`` in descending order; those with one largest length are one."""
    total = sum(large.values())
    k = max(1, min(groups, 2 * math.isqrt(total)))
    cuts = [total * (i + 1) // k for i in range(k)]
    runs: list[list[list[int]]] = []
    seen, at, new = 0, 0, True
    for n in sorted(large, reverse=True):
        left = large[n]
        while left:
            if seen == cuts[at]:
                at, new = at + 1, True
            take = min(left, cuts[at] - seen)
            if new and not (runs and runs[-1][0][0] == n):
                runs.append([])
            new = False
            runs[-1].append([n, take])
            left, seen = left - take, seen + take
    return runs


def _take(run: list[list[int]], n: int) -> list[list[int]]:
    out = []
    while n:
        k = min(n, run[0][1])
        out.append([run[0][0], k])
        run[0][1] -= k
        n -= k
        if not run[0][1]:
            run.pop(0)
    return out


def _fill(sizes: np.ndarray, value: np.ndarray, fluid: float, capacity: int, gap: int) -> np.ndarray:
    """The configuration of most value, as counts per size (descending sizes) and its room for small pieces in sequences.

    ``value`` is that of one piece of each size, ``fluid`` that of a sequence of room; room of under ``gap`` is worth nothing.
    """
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        ok = np.searchsorted(-sizes, -c)
        v = best[c - sizes[ok:]] + value[ok:]
        j = int(np.argmax(v))
        if v[j] > best[c - 1] + 1e-12:
            best[c], pick[c] = v[j], ok + j
        else:
            best[c] = best[c - 1]
    free = capacity - np.arange(capacity + 1)
    c = int(np.argmax(best + np.where(free >= gap, fluid * free / capacity, 0)))
    out = np.zeros(len(sizes) + 1)
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= sizes[pick[c]]
    out[-1] = _room(out[:-1], sizes, capacity, gap)
    return out


def _room(counts: np.ndarray, sizes: np.ndarray, capacity: int, gap: int) -> float:
    free = capacity - int(counts @ sizes)
    return free / capacity if free >= gap else 0.0


def _configurations(sizes: list[int], need: list[int], fluid: int, capacity: int, gap: int, most_columns: int = 2000):
    """(counts per size, times): the integer part of the best fractional configurations for ``need`` and the fluid."""
    if not sizes:
        return []
    s, n = np.array(sizes), len(sizes)
    d = np.array([*need, fluid / capacity], float)
    # columns: one size as often as it fits, and a sequence of fluid alone (or, if the room left exceeds it, the surplus)
    base, cost = np.zeros((n + 1, n + 1)), np.ones(n + 1)
    for i, k in enumerate(capacity // s):
        base[i, i] = k
        base[n, i] = _room(base[:n, i], s, capacity, gap)
    base[n, n] = 1
    surplus = np.zeros(n + 1)
    surplus[n] = -1
    if np.linalg.solve(base, d)[n] < 0:
        base[:, n], cost[n] = surplus, 0
    for _ in range(most_columns):
        y = np.linalg.solve(base.T, cost)
        if y[n] < -1e-9:
            a, price = surplus, 0
        else:
            a, price = _fill(s, np.maximum(y[:n], 0), max(y[n], 0), capacity, gap), 1
            if y @ a <= 1 + 1e-6:
                break
        x, move = np.linalg.solve(base, d), np.linalg.solve(base, a)
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        base[:, out], cost[out] = a, price
    x = np.linalg.solve(base, d)
    found, rest = [], np.array(need, np.int64)
    for j in np.argsort(-x, kind="stable"):
        a = np.rint(base[:n, j]).astype(np.int64)
        used = a > 0
        if cost[j] and used.any():
            times = int(min(np.floor(x[j] + 1e-6), (rest[used] // a[used]).min()))
            if times > 0:
                found.append((a, times))
                rest -= times * a
    return found


def _best_fit(bins: list[Bins], small: dict[int, int], capacity: int) -> list[Bins]:
    room: dict[int, list[Bins]] = {}
    for b in bins:
        room.setdefault(capacity - sum(b.lengths), []).append(b)
    order = sorted(room)

    def put(b: Bins) -> None:
        r = capacity - sum(b.lengths)
        if r not in room:
            room[r] = []
            bisect.insort(order, r)
        room[r].append(b)

    for n in sorted(small, reverse=True):
        left = small[n]
        while left:
            i = bisect.bisect_left(order, n)
            if i == len(order):
                per = capacity // n
                if left >= per:
                    put(Bins((n,) * per, left // per))
                    left %= per
                if left:
                    put(Bins((n,) * left, 1))
                break
            r = order[i]
            b = room[r].pop()
            if not room[r]:
                del room[r]
                order.pop(i)
            k = min(left, b.count)
            left -= k
            if b.count > k:
                put(Bins(b.lengths, b.count - k))
            put(Bins(b.lengths + (n,), k))
    return [b for bs in room.values() for b in bs]


def places(bins: list[Bins]) -> tuple[np.ndarray, ...]:
    """Runs of equal places, sorted by (length, first rank): key, first rank, first sequence, offset."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for b in bins:
        at = 0
        for n in b.lengths:
            rows.append((n, rank.get(n, 0), seq, at))
            rank[n] = rank.get(n, 0) + b.count
            at += n
        seq += b.count
    rows.sort()
    n, first, start, at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    return (n << 44) + first, first, start, at


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, groups: int = 192) -> DataFrame:
    """Where every piece of every document goes: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A document is the ids of its whole text (null: none), then ``end``. Documents over ``capacity`` are cut into pieces
    of ``capacity`` and a rest; no other is cut. Each sequence holds at most ``capacity`` ids, its pieces lie without
    gaps. One row per piece, so at least one per row of ``df`` (repeated rows are packed each for itself); an empty table
    gives no rows. The pieces are written once, so that their numbering survives lost executors; only the histogram of
    lengths (``capacity`` numbers) reaches the driver, only its plan goes out.
    """
    cut = settle(pieces(df, path, key, text, capacity, end))
    tally = settle(cut.groupBy("pid", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(tally.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    held = df.sparkSession.sparkContext.broadcast(places(plan(counts, capacity, groups)))

    def run(batches):
        keys, first, seq, at = held.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq[i] + rank - first[i]), pa.array(at[i])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    ranked = cut.join(starts, ["pid", "length"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
