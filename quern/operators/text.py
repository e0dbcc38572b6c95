"""Text vectorizers: terms, character n-grams, TF-IDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, Model
from quern.errors import InvalidInput
from quern.functions.exprs import num, q


def token_array(c: Column, pattern: str | None) -> Column:
    """White-space separated tokens, or all matches of a pattern."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\S+" if pattern is None else "(?U)" + pattern), F.lit(0))
    return F.filter(found, lambda t: t != "")


def _joined(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def _cut(text: Column, n: int):
    return lambda i: F.substr(text, i, F.lit(n))


def word_grams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo to hi tokens, joined by a space."""
    sizes = []
    for n in range(lo, hi + 1):
        last = F.size(tokens) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        sizes.append(F.transform(starts, _joined(tokens, n)))
    return F.concat(*sizes) if len(sizes) > 1 else sizes[0]


def char_grams(text: Column, lo: int, hi: int) -> Column:
    sizes = []
    for n in range(lo, hi + 1):
        last = F.length(text) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        sizes.append(F.transform(starts, _cut(text, n)))
    return F.concat(*sizes) if len(sizes) > 1 else sizes[0]


class Counts(Model):
    """One double column per term with its count in the text; a null text counts nothing."""

    def __init__(self, est: Vectorizer, terms: list[str]):
        self.est, self.terms = est, terms

    def required(self):
        return [(self.est.column, T.StringType)]

    def count_array(self) -> Column:
        """The counts of all terms, as one array: the text's terms are grouped once, not once a column."""
        grams = self.est.grams(F.coalesce(q(self.est.column), F.lit("")))
        terms = F.array(*[F.lit(t) for t in self.terms])
        known = F.filter(grams, lambda g: F.array_contains(terms, g))
        tally = F.map_from_entries(_tallied(known))
        return let(tally, lambda m: F.transform(terms, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0)).cast("double")))

    def prepare(self, df):
        return df.withColumn("__counts", self.count_array()) if self.terms else df

    def outputs(self, schema):
        return [(t, F.element_at("__counts", i + 1)) for i, t in enumerate(self.terms)]


class Vectorizer(Estimator):
    def __init__(self, column, ngram_range, max_features, min_df, max_df, lowercase):
        self.column, self.ngram_range, self.lowercase = column, ngram_range, lowercase
        self.max_features, self.min_df, self.max_df = max_features, min_df, max_df

    def grams(self, text: Column) -> Column:
        raise NotImplementedError

    def start(self, df) -> None:
        if not df.columns or df.isEmpty():
            raise InvalidInput("the frame is empty")
        if not self.column:
            raise InvalidInput("no column is configured")
        if self.column not in df.columns or not isinstance(df.schema[self.column].dataType, T.StringType):
            raise InvalidInput(f"'{self.column}' is not a string column")
        lo, hi = self.ngram_range
        if not 1 <= lo <= hi:
            raise InvalidInput("ngram_range must satisfy 1 <= lo <= hi")
        if self.min_df < 1 or not 0 < self.max_df <= 1 or self.max_features is not None and self.max_features < 1:
            raise InvalidInput("min_df and max_features are at least 1, max_df lies in (0, 1]")

    def in_range(self, n: int) -> Column:
        return (F.col("df") >= self.min_df) & (F.col("df") <= self.max_df * n)

    def vocabulary(self, df: DataFrame) -> tuple[list[str], dict[str, int], int]:
        """(terms by total count, then alphabetically; document frequencies; documents, null ones included)."""
        self.start(df)
        n = df.count()
        docs = df.select(self.grams(q(self.column)).alias("g")).where("g is not null")
        per_doc = docs.select(F.explode(_tallied(F.col("g"))).alias("t")).select("t.term", "t.n")
        kept = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).where(self.in_range(n))
        ranked = kept.orderBy(F.desc("total"), F.asc("term"))
        rows = (ranked.limit(self.max_features) if self.max_features is not None else ranked).collect()
        return [r.term for r in rows], {r.term: r.df for r in rows}, n

    def _fit(self, df, target=None):
        return Counts(self, self.vocabulary(df)[0])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an expression would be computed per element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _tallied(grams: Column) -> Column:
    """``array<struct<term, n>>`` of a text's grams, each term once: runs of the sorted array."""

    def starts(ordered: Column) -> Column:
        every = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, F.greatest(i - 1, F.lit(0)))))

    def runs(ordered: Column, marks: Column) -> Column:
        n = F.size(ordered)
        return F.transform(marks, lambda a, i: F.struct(F.get(ordered, a).alias("term"), (F.coalesce(F.get(marks, i + 1), n) - a).cast("long").alias("n")))

    return let(F.array_sort(grams), lambda ordered: let(starts(ordered), lambda marks: runs(ordered, marks)))


class CountVectorizer(Vectorizer):
    """Counts of word n-grams. ``tokenizer`` is a pattern, or None for white space; stop words go before n-grams."""

    def __init__(self, column: str, tokenizer: str | None = None, ngram_range=(1, 1), max_features=None, min_df=1, max_df=1.0, stop_words=(), lowercase=True):
        super().__init__(column, ngram_range, max_features, min_df, max_df, lowercase)
        self.tokenizer, self.stop_words = tokenizer, sorted(stop_words)

    def start(self, df):
        super().start(df)
        if self.tokenizer is not None:
            try:
                re.compile(self.tokenizer)
            except re.error as e:
                raise InvalidInput(f"bad pattern '{self.tokenizer}': {e}") from e

    def grams(self, text):
        tokens = token_array(F.lower(text) if self.lowercase else text, self.tokenizer)
        if self.stop_words:
            tokens = F.filter(tokens, lambda t: ~t.isin(self.stop_words))
        return tokens if self.ngram_range == (1, 1) else let(tokens, lambda t: word_grams(t, *self.ngram_range))


class CharacterNGramVectorizer(Vectorizer):
    """Counts of character n-grams: of the whole text (``char``, runs of white space collapsed) or of padded words (``char_wb``)."""

    def __init__(self, column: str, analyzer: str = "char", ngram_range=(2, 4), max_features=None, min_df=1, max_df=1.0, lowercase=True):
        if analyzer not in ("char", "char_wb"):
            raise InvalidInput(f"unknown analyzer '{analyzer}'")
        super().__init__(column, ngram_range, max_features, min_df, max_df, lowercase)
        self.analyzer = analyzer

    def in_range(self, n):
        return (F.col("df") >= self.min_df) & (F.col("df") / n <= self.max_df)

    def grams(self, text):
        text = F.lower(text) if self.lowercase else text
        if self.analyzer == "char":
            return let(F.regexp_replace(text, r"(?U)\s{2,}", " "), lambda t: char_grams(t, *self.ngram_range))
        padded = F.transform(token_array(text, None), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        return F.flatten(F.transform(padded, lambda w: char_grams(w, *self.ngram_range)))


class Weights(Counts):
    def __init__(self, est, terms, idf):
        super().__init__(est, terms)
        self.idf = idf

    def prepare(self, df):
        if not self.terms:
            return df
        est, c = self.est, self.count_array()
        if est.sublinear_tf:
            c = F.transform(c, lambda x: F.when(x > 0, 1.0 + F.log(F.when(x > 0, x))).otherwise(0.0))
        df = df.withColumn("__counts", c)
        total = F.aggregate("__counts", num(0), lambda a, x: a + x)
        if est.tf_weighting == "frequency":
            w = F.transform("__counts", lambda x: F.when(F.col("__total") > 0, x / F.when(F.col("__total") > 0, F.col("__total"))).otherwise(0.0))
        elif est.tf_weighting == "binary":
            w = F.transform("__counts", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
        elif est.tf_weighting == "log":
            w = F.transform("__counts", lambda x: F.when(x > 0, 1.0 + F.log(F.when(x > 0, x))).otherwise(0.0))
        else:
            w = F.col("__counts")
        idf = F.array(*[num(v) for v in self.idf])
        df = df.withColumn("__total", total).withColumn("__counts", F.zip_with(w, idf, lambda a, b: a * b))
        if est.norm:
            size = F.aggregate("__counts", num(0), lambda a, x: a + (F.abs(x) if est.norm == "l1" else x * x))
            df = df.withColumn("__total", F.sqrt(size) if est.norm == "l2" else size)
            df = df.withColumn("__counts", F.transform("__counts", lambda x: F.when(F.col("__total") > 0, x / F.when(F.col("__total") > 0, F.col("__total"))).otherwise(x)))
        return df


class TFIDFVectorizer(CountVectorizer):
    """Term counts, then TF weighting (``raw``, ``frequency`` over vocabulary terms, ``binary``, ``log``), IDF
    (``unsmoothed``, ``smoothed``, ``probabilistic``) and row norm (None, ``l1``, ``l2``)."""

    def __init__(self, column: str, tf_weighting="raw", idf_weighting="smoothed", norm: str | None = "l2", sublinear_tf=False, **words):
        super().__init__(column, **words)
        if tf_weighting not in ("raw", "frequency", "binary", "log") or idf_weighting not in ("unsmoothed", "smoothed", "probabilistic") or norm not in (None, "l1", "l2"):
            raise InvalidInput("unknown weighting or norm")
        self.tf_weighting, self.idf_weighting, self.norm, self.sublinear_tf = tf_weighting, idf_weighting, norm, sublinear_tf

    def _fit(self, df, target=None):
        import math

        terms, df_of, n = self.vocabulary(df)
        formula = {
            "unsmoothed": lambda d: math.log(n / d),
            "smoothed": lambda d: math.log((1 + n) / (1 + d)) + 1,
            "probabilistic": lambda d: math.log((n - d + 0.5) / (d + 0.5)),
        }[self.idf_weighting]
        return Weights(self, terms, [formula(df_of[t]) for t in terms])
