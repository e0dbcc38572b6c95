"""Benchmark decontamination by canonical templates, window joins and slot consistency."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import forget, settle

WINDOW = 5
WORD = re.compile(r"\d[\d.,]*\d|[%€$£]|[^\W_]+")
_NUMBER = re.compile(r"\d[\d.,]*\d|\d+")
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion dozen".split())
UNITS = frozenset(
    """kg g mg lb lbs oz ton tons tonne tonnes km m cm mm ft foot feet inch inches yard yards mile miles l ml litre litres liter liters gallon gallons
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent dollar dollars cent cents euro euros
    pound pounds € $ £ usd eur kmh mph""".split()
)
_NAME = re.compile(r"(?<=[^\W\d_])[,;]?[ \t]+([^\W\d_a-z][^\W\d_A-Z]+)")
_CAPITAL = re.compile(r"[^\W\d_a-z][^\W\d_A-Z]+")
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[str]:
    """Lower-cased words, numbers and currency or percent signs of a whole text."""
    return WORD.findall(text.lower())


def template(text: str, initial: bool = False) -> tuple[list[str], list[str | None]]:
    """Canonical tokens and, where a token is a placeholder, the value in its slot.

    Numbers (digits or number words) become ``<num>``, a unit beside a number ``<unit>``, a capitalised word inside a
    sentence ``<name>``; with ``initial``, one that begins a sentence, line or quotation too. Everything else is lower-cased.
    """
    names = {m.start(1) for m in _NAME.finditer(text) if m.group(1)[0].isupper()}
    toks, slots = [], []
    found = [(m.start(), m.group()) for m in WORD.finditer(text)]
    low = [w.lower() for _, w in found]
    number = [w[0].isdigit() and bool(_NUMBER.fullmatch(w)) or w in NUMBER_WORDS for w in low]
    for i, (at, word) in enumerate(found):
        if number[i]:
            toks.append("<num>"), slots.append("n:" + low[i].replace(",", ""))
        elif low[i] in UNITS and (i and number[i - 1] or low[i] in "$€£" and i + 1 < len(low) and number[i + 1]):
            toks.append("<unit>"), slots.append("u:" + low[i])
        elif at in names or initial and word[0].isupper() and _CAPITAL.match(word):
            toks.append("<name>"), slots.append("p:" + low[i])
        else:
            toks.append(low[i]), slots.append(None)
    return toks, slots


_SPLIT = re.compile(f"({WORD.pattern})")
_INNER = re.compile(r"[,;]?[ \t]+")  # what stands between a letter and a capitalised word of the same sentence
_NUMBER_BIT, _UNIT_BIT, _SIGN_BIT, _CAPITAL_BIT, _LETTER_BIT = 1, 2, 4, 8, 16


class Words:
    """Numbers of words; what a word is by itself is remembered, for up to ``size`` words. Number 0 is the end of a text."""

    def __init__(self, size: int = 1 << 19):
        self.size = size
        self.num, self.unit, self.name = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("<num>", "<unit>", "<name>"))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.inner: dict[str, bool] = {}
        self.hash, self.kind, self.used = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8), 1

    def cut(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, their numbers, and whether what stands before each lets it be inside a sentence."""
        parts = _SPLIT.split(text)
        words, gaps = parts[1::2], parts[:-1:2]
        try:
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in set(words):
                if w not in self.number:
                    self._learn(w)
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        try:
            inner = np.fromiter(map(self.inner.__getitem__, gaps), bool, len(gaps))
        except KeyError:
            if len(self.inner) > 1 << 16:
                self.inner.clear()
            self.inner.update({g: bool(_INNER.fullmatch(g)) for g in set(gaps)})
            inner = np.fromiter(map(self.inner.__getitem__, gaps), bool, len(gaps))
        return words, ids, inner

    def _learn(self, w: str) -> None:
        low, i = w.lower(), self.used
        if i == len(self.hash):
            self.hash, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.kind))
        is_number = low[0].isdigit() and bool(_NUMBER.fullmatch(low)) or low in NUMBER_WORDS
        self.kind[i] = (
            is_number * _NUMBER_BIT | (low in UNITS) * _UNIT_BIT | (low in "$€£") * _SIGN_BIT
            | (w[0].isupper() and bool(_CAPITAL.match(w))) * _CAPITAL_BIT | (w[-1].isalpha()) * _LETTER_BIT
        )
        self.hash[i] = xxhash.xxh3_64_intdigest(low)
        self.number[w] = i
        self.used = i + 1

    def windows(self, ids: np.ndarray, inner: np.ndarray, templates: bool):
        """(kind, hashes, slot types, positions) of the windows of :func:`_windows_of`, for texts that end in number 0 each.

        A slot type is 0 for none, else n, u or p as 1, 2 or 3. No window reaches over the end of a text.
        """
        end = ids == 0
        whole = np.flatnonzero(np.convolve(end, np.ones(WINDOW, np.int8), "valid") == 0)
        h, k = self.hash[ids], self.kind[ids]
        yield 0, _mix(h, len(h) - WINDOW + 1, WINDOW)[whole], None, whole
        if not templates:
            return
        number = k & _NUMBER_BIT != 0
        beside = np.zeros(len(k), bool)
        beside[1:] = number[:-1]
        beside[:-1] |= (k[:-1] & _SIGN_BIT != 0) & number[1:]
        typed = np.where(number, 1, np.where((k & _UNIT_BIT != 0) & beside, 2, 0)).astype(np.uint8)
        capital = (k & _CAPITAL_BIT != 0) & (typed == 0)
        inside = capital & inner
        inside[0] = False
        inside[1:] &= k[:-1] & _LETTER_BIT != 0
        for kind, name in ((1, inside), (2, capital)):
            t = np.where(name, np.uint8(3), typed)
            n = np.convolve(t != 0, np.ones(WINDOW, np.int8), "valid")[whole]
            at = whole[(n > 0) & (n < WINDOW)]
            th = np.choose(t, (h, self.num, self.unit, self.name))
            yield kind, _mix(th, len(th) - WINDOW + 1, WINDOW)[at], t, at


def _slot(word: str, kind: int) -> str:
    low = word.lower()
    return ("n:" + low.replace(",", ""), "u:" + low, "p:" + low)[kind - 1]


class Hasher:
    """64-bit hashes of windows of tokens; token hashes are remembered, up to a fixed number."""

    def __init__(self, size: int = 1 << 20):
        self.known: dict[str, int] = {}
        self.size = size

    def windows(self, toks: list[str], width: int = WINDOW) -> np.ndarray:
        """One hash per window; fewer tokens make one window of their own kind, none give no window."""
        if not toks:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.size:
            known.clear()
        for t in set(toks):
            if t not in known:
                known[t] = xxhash.xxh3_64_intdigest(t)
        return _windows(np.fromiter(map(known.__getitem__, toks), np.uint64, len(toks)), width)


def _windows(h: np.ndarray, width: int = WINDOW) -> np.ndarray:
    if len(h) < width:
        return _mix(h, 1, len(h)) ^ np.uint64(0x5851F42D4C957F2D)
    return _mix(h, len(h) - width + 1, width)


def _mix(h: np.ndarray, n: int, width: int) -> np.ndarray:
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = x * _MIX + h[k : k + n]
        x ^= x >> np.uint64(29)
    return x * _ODD


def _slotted(toks: list[str], slots: list[str | None], width: int = WINDOW) -> np.ndarray:
    """Positions of windows that hold a slot and a literal word: placeholders alone say nothing."""
    if not toks:
        return np.zeros(0, np.int64)
    s = slots != 0 if isinstance(slots, np.ndarray) else np.array([x is not None for x in slots])
    w = min(width, len(toks))
    n = np.convolve(s.astype(int), np.ones(w, int), "valid")
    return np.flatnonzero((n > 0) & (n < w))


_SHAPE = "item string, at int, kind int, h bigint, slots array<string>"


def _windows_of(text: str, hasher: Hasher):
    """(position, kind, hash, slot values) of a benchmark text; kind 0: literal words, 1: template, 2: template with initial names."""
    lit = hasher.windows(tokens(text))
    out = [(i, 0, int(h), []) for i, h in enumerate(lit.view(np.int64).tolist())]
    for kind in (1, 2):
        toks, slots = template(text, kind == 2)
        tpl = hasher.windows(toks)
        for i in _slotted(toks, slots).tolist():
            out.append((i, kind, int(tpl[i : i + 1].view(np.int64)[0]), [x for x in slots[i : i + WINDOW] if x is not None]))
    return out


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``at``, ``kind``, ``h``, ``slots`` and ``n`` (literal windows of the item) of every window of every item.

    Null, empty and wordless texts give no window, fewer than five words one window of their own kind; very long texts
    are cut whole; repeated items give their windows again; an empty table gives none.
    """
    kind = items.schema[item].dataType.simpleString()

    def run(batches):
        hasher = Hasher()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = _windows_of(t or "", hasher)
                n = len({r[0] for r in rows if r[1] == 0})
                for r in rows:
                    for c, v in zip(cols, (i, *r, n), strict=True):
                        c.append(v)
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "at", "kind", "h", "slots", "n"])

    return items.select(item, text).mapInArrow(run, f"item {kind}, at int, kind int, h bigint, slots array<string>, n int")


def contaminated(
    df: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    least: float = 0.8,
    log2_bits: int = 25,
) -> DataFrame:
    """Pairs of documents and benchmark items of whose 5-word windows the document holds at least ``least``.

    Columns: ``key``, ``item``, ``n_windows`` (of the item), ``n_literal`` (found word for word), ``n_matched`` (found
    word for word, or as a template with consistent slots), ``coverage`` and ``kind`` (``literal`` if the words alone
    reach ``least``, else ``template``). Only pairs that reach it are returned.

    Both sides are cut into windows of five words, numbers, names and units also replaced by typed placeholders. A bit
    table of fixed size (``2 ** log2_bits``) that holds the benchmark's windows goes to the executors; only document
    windows it knows are shuffled, to be hash-joined with the benchmark exactly (64-bit hashes), first those that few
    items share. Template windows
    count only if, along one alignment of document and item, every name and unit of the item maps to one in the
    document, and so does every number but one (two quantities of an item may be equal by chance); so re-parameterised questions are found, and chance matches of placeholders are not. Both sides have a second
    template in which capitalised words that begin a sentence are names too; its slots must be consistent by themselves.

    Nulls, empty texts and texts without words match nothing; an item of fewer than five words is matched only by a
    document of just those words. Rows with equal keys count as one document; a null key is one document. Repeated
    items with one id count once. Empty tables give no rows; other columns are not read.
    """
    spark = df.sparkSession
    bench = settle(benchmark_windows(items.where(F.col(item_text).isNotNull()), item, item_text))
    bits = np.zeros((1 << log2_bits) // 8, np.uint8)
    shift, mark = 64 - log2_bits, F.lit((1 << log2_bits) - 1)
    slot = F.shiftrightunsigned("h", shift).bitwiseAND(mark)
    for r in bench.select("kind", slot.alias("s")).distinct().toLocalIterator():  # at most three per bit of the fixed table
        bits[r.s >> 3] |= 1 << (r.s & 7)
    templates = bench.where("kind > 0").limit(1).count() > 0
    table = spark.sparkContext.broadcast(bits)

    def run(batches):
        known, seen = table.value, Words()

        def hit(h):
            s = (h >> np.uint64(shift)).astype(np.int64)
            return (known[s >> 3] >> (s & 7).astype(np.uint8)) & 1 != 0

        def found(held: list[tuple]):
            """(number of the text, position, kind, hash, slot values) of the windows that the table knows, for texts at once."""
            ids = np.concatenate([x for _, i, _ in held for x in (i, np.zeros(1, np.int32))])
            inner = np.concatenate([x for _, _, g in held for x in (g, np.zeros(1, bool))])
            start = np.cumsum([0, *(len(i) + 1 for _, i, _ in held)])[:-1]
            for kind, h, typed, at in seen.windows(ids, inner, templates):
                yes = hit(h)
                h, at = h[yes], at[yes]
                doc = np.searchsorted(start, at, "right") - 1
                if kind == 0:  # where a literal window stands does not matter
                    once = np.unique(np.stack([doc.view(np.uint64), h], 1), axis=0, return_index=True)[1]
                    h, at, doc = h[once], at[once], doc[once]
                for d, p, v in zip(doc.tolist(), (at - start[doc]).tolist(), h.view(np.int64).tolist(), strict=True):
                    w, q = held[d][0][p : p + WINDOW], p + start[d]
                    yield d, p, kind, v, [_slot(x, t) for x, t in zip(w, typed[q : q + WINDOW].tolist(), strict=True) if t] if kind else []

        def batch(keys, held, kind_of_key):
            cols: list[list] = [[] for _ in range(5)]
            for d, *r in found(held) if held else ():
                for c, v in zip(cols, (keys[d].as_py(), *r), strict=True):
                    c.append(v)
            return _hits(cols, kind_of_key)

        for b in batches:
            keys, held, size, odd = [], [], 0, [[] for _ in range(5)]
            for i, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py()
                if not t:
                    continue
                cut = seen.cut(t)
                if len(cut[0]) < WINDOW or "\u0130" in t:  # one window of its own kind; a letter that is two in lower case
                    for r in _windows_of(t, Hasher()) if cut[0] else ():
                        if hit(np.array([r[2]], np.int64).view(np.uint64))[0]:
                            for c, v in zip(odd, (i.as_py(), *r), strict=True):
                                c.append(v)
                    continue
                keys.append(i), held.append(cut)
                size += len(cut[0])
                if size > 1 << 18:
                    yield batch(keys, held, b.schema.field(0).type)
                    keys, held, size = [], [], 0
                    if seen.used > seen.size:
                        seen.clear()
            yield batch(keys, held, b.schema.field(0).type)
            yield _hits(odd, b.schema.field(0).type)
            if seen.used > seen.size:
                seen.clear()

    kind = df.schema[key].dataType.simpleString()
    hits = settle(df.select(key, text).mapInArrow(run, f"doc {kind}, pos int, kind int, h bigint, vals array<string>"))
    pairs = settle(_candidates(hits, bench, least))
    of_pair = hits.join(pairs.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d"))).drop("d")
    mine = bench.withColumnRenamed("item", "i").withColumnRenamed("h", "g").withColumnRenamed("kind", "k")
    met = of_pair.join(mine, F.col("item").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")) & (F.col("kind") == F.col("k"))).drop("i", "g", "k")
    literal = met.where("kind = 0").select("doc", "item", "at", "n", F.lit(0).alias("kind"))
    found = literal
    if templates:
        tpl = met.where("kind > 0").withColumn("way", F.col("pos") - F.col("at"))
        slot_pairs = tpl.select("doc", "item", "kind", "way", F.explode(F.arrays_zip(F.col("slots").alias("mine"), F.col("vals").alias("theirs"))).alias("p"))
        each = slot_pairs.select("doc", "item", "kind", "way", "p.mine", "p.theirs").distinct().groupBy("doc", "item", "kind", "way", "mine").agg(F.count("*").alias("values"))
        torn = F.when(F.col("values") > 1, 1).otherwise(0)
        number = F.startswith(F.col("mine"), F.lit("n:"))
        odd = each.groupBy("doc", "item", "kind", "way").agg(F.sum(F.when(number, torn).otherwise(0)).alias("numbers"), F.sum(F.when(number, 0).otherwise(torn)).alias("others"))
        good = odd.where("others = 0 and numbers <= 1").select(F.col("doc").alias("d"), F.col("item").alias("i"), F.col("kind").alias("k"), F.col("way").alias("w"))
        kept = tpl.join(good, F.col("doc").eqNullSafe(F.col("d")) & F.col("item").eqNullSafe(F.col("i")) & (F.col("kind") == F.col("k")) & (F.col("way") == F.col("w")), "left_semi")
        found = literal.union(kept.select("doc", "item", "at", "n", "kind"))
    per_window = found.groupBy("doc", "item", "at").agg(F.max("n").alias("n"), F.min("kind").alias("kind"))
    out = per_window.groupBy("doc", "item").agg(
        F.max("n").cast("long").alias("n_windows"), F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("n_literal"), F.count("*").alias("n_matched")
    )
    out = out.where(F.col("n_matched") >= F.lit(least) * F.col("n_windows"))
    out = out.select(
        F.col("doc").alias(key),
        F.col("item").alias(item),
        "n_windows",
        "n_literal",
        "n_matched",
        (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        F.when(F.col("n_literal") >= F.lit(least) * F.col("n_windows"), "literal").otherwise("template").alias("kind"),
    )
    out = settle(out)
    for used in (hits, bench, pairs):
        forget(used)
    return out


def _hits(cols: list[list], key: pa.DataType) -> pa.RecordBatch:
    kinds = (key, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "pos", "kind", "h", "vals"])


def _candidates(hits: DataFrame, bench: DataFrame, least: float) -> DataFrame:
    """``doc``, ``item``: pairs that share one of the item's rarest windows, so many that no pair can reach ``least`` without.

    A pair that holds ``least`` of an item's n windows misses fewer than ``n - ceil(least * n) + 1``. Rare are windows
    that few items hold; so windows that many items and documents share meet in no join.
    """
    shared = bench.groupBy("h", "kind").agg(F.count_distinct("item").alias("items"))
    place = bench.join(shared, ["h", "kind"]).groupBy("item", "at").agg(F.max("items").alias("items"), F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "at"))
    rare = place.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    rare = rare.select(F.col("item").alias("i"), F.col("at").alias("a"))
    keys = bench.join(rare, F.col("item").eqNullSafe(F.col("i")) & (F.col("at") == F.col("a"))).select("h", "kind", "item").distinct()
    return hits.select("doc", "h", "kind").distinct().join(keys, ["h", "kind"]).select("doc", "item").distinct()
