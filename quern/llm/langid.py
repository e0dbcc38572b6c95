"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, settle

LETTER = re.compile(r"[^\W\d_]")
_BITS = 21  # of a letter; a trigram's key is exact
_ONE, _TWO = np.int64((1 << _BITS) - 1), np.int64((1 << 2 * _BITS) - 1)
_SMALL = 128  # symbols under this are counted in a table, trigrams of any other by sorting
_TABLE: np.ndarray | None = None
_CHUNK = 1 << 17


def _table() -> np.ndarray:
    """Symbol of each code point: 0 for everything but letters, 1-26 a-z, 27-127 the letters from U+00DF on, else 128 + code point."""
    global _TABLE
    if _TABLE is None:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        t = np.where(letter, np.arange(_SMALL, 0x110000 + _SMALL), 0).astype(np.int64)
        t[97:123] = np.arange(1, 27)
        near = np.flatnonzero(letter[0xDF : 0xDF + 200])[: _SMALL - 27] + 0xDF
        t[near] = np.arange(27, 27 + len(near))
        _TABLE = t
    return _TABLE


def symbols() -> int:
    """How many symbols there are: the letters of Unicode and one for all else."""
    return int((_table() > 0).sum()) + 1


def trigrams(text: str) -> np.ndarray:
    """Keys of a text's character trigrams: lower-cased, runs of non-letters are one separator, one stands at each end."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(code) + 3, np.int64)
    c[2:-1] = _table()[code]
    keep = np.ones(len(c), bool)
    keep[3:] = (c[3:] != 0) | (c[2:-1] != 0)
    c = c[keep]
    return (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``; the place after the last for those that are not there."""
    i = np.searchsorted(keys, wanted)
    if len(keys):
        i[keys[np.minimum(i, len(keys) - 1)] != wanted] = len(keys)
    return i


@dataclass
class LanguageModel:
    """Sorted arrays of the trigrams, bigrams and symbols seen in any language, with one column of log values per language
    and a last row for whatever none has seen.

    ``tri``: log probability of a trigram; ``back``: log mass that a two-symbol context leaves to bigrams; ``bi``, ``lean``:
    the same of bigrams and one-symbol contexts; ``uni``: log probability of a symbol. ``heat`` calibrates the scores,
    ``mean``, ``spread`` and ``bound`` the rejection.
    """

    langs: list[str]
    keys3: np.ndarray
    tri: np.ndarray
    keys2: np.ndarray
    bi: np.ndarray
    back: np.ndarray
    keys1: np.ndarray
    uni: np.ndarray
    lean: np.ndarray
    heat: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    bound: float = np.inf

    def _log2(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of bigrams, one column per language."""
        i = _find(self.keys2, key)
        out, miss = self.bi[i], np.flatnonzero(i == len(self.keys2))
        if len(miss):
            k = key[miss]
            out[miss] = self.lean[_find(self.keys1, k >> _BITS)] + self.uni[_find(self.keys1, k & _ONE)]
        return out

    def logp(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams, one column per language."""
        i = _find(self.keys3, key)
        out, miss = self.tri[i], np.flatnonzero(i == len(self.keys3))
        if len(miss):
            k = key[miss]
            out[miss] = self.back[_find(self.keys2, k >> _BITS)] + self._log2(k & _TWO)
        return out

    def entropy(self, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy per symbol (nats) under each language's model, over the whole text, and the number of symbols."""
        total, key = np.zeros(len(self.langs)), trigrams(text)
        for at in range(0, len(key), _CHUNK):
            total += self.logp(key[at : at + _CHUNK]).sum(0, dtype=np.float64)
        return -total / max(len(key), 1), len(key)

    def odd(self, h: np.ndarray, n: np.ndarray | int, own: np.ndarray | int) -> np.ndarray | float:
        """By how many standard errors of texts of ``n`` symbols a cross-entropy is over the language's own."""
        return (h - self.mean[own]) * np.sqrt(n) / self.spread[own]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected); ``und``, 0 and True for texts without a letter."""
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0, True
        h, n = self.entropy(text)
        best = int(np.argmin(h))
        z = np.exp(-self.heat * (h - h[best]))
        return self.langs[best], float(1 / z.sum()), bool(self.mean is not None and self.odd(h[best], n, best) > self.bound)


def kneser_ney(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """Interpolated Kneser-Ney models of order 3 from each language's sorted trigram keys and counts.

    Discounts are n1 / (n1 + 2 n2) per order; lower orders use continuation counts and the unigrams back off to the
    uniform distribution over all letters, so that every trigram has a probability under every model.
    """
    join = lambda parts: np.unique(np.concatenate([*parts, np.zeros(0, np.int64)])).astype(np.int64)
    keys3 = join(counts[x][0] for x in langs)
    keys2 = join(np.concatenate([counts[x][0] & _TWO, counts[x][0] >> _BITS]) for x in langs)
    keys1 = join(np.concatenate([keys2 & _ONE, keys2 >> _BITS]) for _ in (0,))
    shape = lambda k, v: np.full((len(k) + 1, len(langs)), v, np.float32)
    m = LanguageModel(list(langs), keys3, shape(keys3, 0), keys2, shape(keys2, 0), shape(keys2, 0), keys1, shape(keys1, 0), shape(keys1, 0))
    for j, lang in enumerate(langs):
        k, c = counts[lang]
        two, n2 = np.unique(k & _TWO, return_counts=True)  # how many symbols stand before a bigram
        one, n1 = np.unique(two & _ONE, return_counts=True)
        d3, d2, d1 = _discount(c), _discount(n2), _discount(n1)
        p1 = np.full(len(keys1) + 1, d1 * len(one) / n1.sum() / symbols())
        p1[_find(keys1, one)] += (n1 - d1) / n1.sum()
        m.uni[:, j] = np.log(p1)
        head, first = np.unique(two >> _BITS, return_index=True)
        tot2, kinds2 = np.add.reduceat(n2, first), np.diff([*first, len(two)])
        lam2 = np.ones(len(keys1) + 1)
        lam2[_find(keys1, head)] = d2 * kinds2 / tot2
        at = np.searchsorted(head, two >> _BITS)
        own2 = (n2 - d2) / tot2[at] + lam2[_find(keys1, two >> _BITS)] * p1[_find(keys1, two & _ONE)]
        m.lean[:, j] = np.log(lam2)
        m.bi[:-1, j] = m.lean[_find(keys1, keys2 >> _BITS), j] + m.uni[_find(keys1, keys2 & _ONE), j]
        m.bi[_find(keys2, two), j] = np.log(own2)
        head, first = np.unique(k >> _BITS, return_index=True)
        tot3, kinds3 = np.add.reduceat(c, first), np.diff([*first, len(k)])
        lam3 = np.ones(len(keys2) + 1)
        lam3[_find(keys2, head)] = d3 * kinds3 / tot3
        at = np.searchsorted(head, k >> _BITS)
        low = np.exp(m.bi[_find(keys2, k & _TWO), j].astype(np.float64))
        m.back[:, j] = np.log(lam3)
        m.tri[:-1, j] = m.back[_find(keys2, keys3 >> _BITS), j] + m.bi[_find(keys2, keys3 & _TWO), j]
        m.tri[_find(keys3, k), j] = np.log((c - d3) / tot3[at] + lam3[_find(keys2, k >> _BITS)] * low)
    return m


def _discount(c: np.ndarray) -> float:
    one, two = (c == 1).sum(), (c == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


def _counts(df: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Trigram counts of each ``lang``: of more than ``most`` kinds, those seen oftenest."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        rare: dict[str, tuple] = {}
        wait: dict[str, list] = {}
        size: dict[str, int] = {}

        def pour(x):
            k = np.concatenate(wait.pop(x))
            big = (k >> 2 * _BITS >= _SMALL) | (k >> _BITS & _ONE >= _SMALL) | (k & _ONE >= _SMALL)
            s = k[~big]
            sums[x] = sums.get(x, 0) + np.bincount(s >> 2 * _BITS << 14 | (s >> _BITS & 127) << 7 | s & 127, minlength=_SMALL**3)
            if big.any():
                old = rare.get(x, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                k, n = np.unique(k[big], return_counts=True)
                keys, at = np.unique(np.concatenate([old[0], k]), return_inverse=True)
                rare[x] = keys, np.bincount(at, np.concatenate([old[1], n]), len(keys)).astype(np.int64)
            size[x] = 0

        def out(x, k, n):
            return pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "k", "n"])

        for b in batches:
            for x, t in zip(b.column(0), b.column(1), strict=True):
                x = x.as_py()
                wait.setdefault(x, []).append(k := trigrams(t.as_py()))
                size[x] = size.get(x, 0) + len(k)
                if size[x] >= 1 << 20:
                    pour(x)
                    if x in rare and len(rare[x][0]) > 1 << 20:  # a task's memory is bounded: the counts meet again later
                        yield out(x, *rare.pop(x))
        for x in list(wait):
            pour(x)
        for x, s in sums.items():
            k = np.flatnonzero(s)
            yield out(x, k >> 14 << 2 * _BITS | (k >> 7 & 127) << _BITS | k & 127, s[k])
        for x, (k, n) in rare.items():
            yield out(x, k, n)

    sums = df.mapInArrow(run, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    sums = settle(sums)
    least: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for r in sums.groupBy("lang", F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("kinds")).orderBy("lang", F.desc("n")).toLocalIterator():
        kinds[r.lang] = kinds.get(r.lang, 0) + r.kinds
        if kinds[r.lang] <= most:
            least[r.lang] = r.n
    few = F.lit(False)
    for x, n in least.items():
        few = few | ((F.col("lang") == x) & (F.col("n") >= n))
    got = sums.where(few).toArrow()  # at most ``most`` rows a language
    forget(sums)
    names, k, n = np.array(got["lang"].to_pylist(), object), got["k"].to_numpy(), got["n"].to_numpy()
    out = {}
    for x in sorted(set(names.tolist())):
        mine = names == x
        order = np.argsort(k[mine])
        out[x] = k[mine][order].astype(np.int64), n[mine][order].astype(float)
    return out


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str | None = None, sample: int = 2000, most: int = 1 << 21) -> LanguageModel:
    """Count the trigrams of rows with a language and a letter, build the models, calibrate them on other rows.

    A sixteenth of the rows, chosen by a hash of ``key`` and text, is left out of the counts; the counts cover all others.
    A model holds at most ``most`` trigrams a language (the oftenest; the others' mass goes to bigrams). Calibration looks
    at about ``sample`` of the rows left out, and at most twice as many, the first by hash: one temperature for the
    scores, and per language the mean cross-entropy and its spread at a text's length; a text is rejected that lies
    further over the mean than 99.9 % of those rows. Where too few rows are left out, the counted ones calibrate.

    Null and empty texts and rows without a language teach nothing; languages without a letter in any text are not
    learned; repeated rows count again; very long texts are read whole; an empty table gives a model without languages.
    """
    place = F.pmod(F.xxhash64(*([key] if key else []), text), F.lit(1 << 24))
    rows = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), place.alias("place"))
    out = rows.where(F.col("place") < 1 << 20)
    left = out.count()
    apart = left >= 64
    counts = _counts((rows.where(F.col("place") >= 1 << 20) if apart else rows).select("lang", "text"), most)
    model = kneser_ney(list(counts), counts)
    if not model.langs:
        return model
    if not apart:
        out, left = rows, max(1, rows.count())
    most_place = (1 << 20 if apart else 1 << 24) * min(1.0, sample / left)
    few = out.where(F.col("place") <= int(most_place)).orderBy("place", "lang").limit(2 * sample)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        at = {x: i for i, x in enumerate(m.langs)}
        for b in batches:
            own, h, size = [], [], []
            for x, t in zip(b.column(0), b.column(1), strict=True):
                if x.as_py() in at:
                    e, n = m.entropy(t.as_py())
                    own.append(at[x.as_py()]), h.append(e.tolist()), size.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(h, pa.list_(pa.float64())), pa.array(size, pa.int64())], names=["own", "h", "n"])

    got = few.select("lang", "text").mapInArrow(run, "own int, h array<double>, n bigint").toArrow()
    if not got.num_rows:
        return model
    own, h, n = got["own"].to_numpy(), np.array(got["h"].to_pylist()), got["n"].to_numpy()
    mine = h[np.arange(len(own)), own]
    heats = 2.0 ** np.arange(-2, 8, 0.25)
    loss = [np.logaddexp.reduce(-t * (h - mine[:, None]), axis=1).mean() for t in heats]
    model.heat = float(heats[int(np.argmin(loss))])
    mean, spread = np.full(len(model.langs), np.average(mine, weights=n)), np.full(len(model.langs), max(1e-6, float(np.sqrt(np.mean(n * (mine - np.average(mine, weights=n)) ** 2)))))
    for j in range(len(model.langs)):
        if (own == j).sum() >= 8:
            mean[j] = np.average(mine[own == j], weights=n[own == j])
            spread[j] = max(1e-6, float(np.sqrt(np.mean(n[own == j] * (mine[own == j] - mean[j]) ** 2))))
    model.mean, model.spread = mean, spread
    model.bound = float(np.quantile(model.odd(mine, n, own), 0.999))
    return model


def identify(df: DataFrame, model: LanguageModel, key: str | Column = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for every row.

    The language with the lowest length-normalised cross-entropy over the whole text, however long, wins; ties go to
    the alphabetically first. ``rejected`` says that even the best model explains the text worse than the calibrated
    bound allows for its length; the caller decides whether that means ``und``. Null texts and texts without a letter
    are ``und`` with score 0, as are all texts if no language was learned. Equal texts (repeated rows) get equal values;
    columns that are not in ``keep`` are not read; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    src = df.select(key, *keep, F.col(text).alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{shape}, lang_pred string, score double, rejected boolean")
