"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from quern.llm import decontam
from quern.llm.queries import QUERIES, SQL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, sf_dir)
    want = c.sql(SQL[name])
    order = sorted(df.columns)
    got = Counter(tuple(str(r[x]) for x in order) for r in df.collect())
    assert sorted(want.columns) == order
    assert got == Counter(tuple(str(r[want.columns.index(x)]) for x in order) for r in want.fetchall())


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).persist())
    return out


def test_pipeline_by_brute_force(spark, sf_dir):
    from test_llm_operators import brute_lines, check_packing, groups

    from quern.llm import quality
    from quern.llm.queries import labelled

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages(spark, docs, sf_dir)
    for df in kept[:-1]:
        assert df.columns == docs.columns
    text = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in kept[:-1]]
    model = quality.fit(labelled(docs, spark, sf_dir), key="doc_id")
    assert set(text[1]) == {d for d, t in text[0].items() if model.score(t) >= 0.3} and 0 < len(text[1]) < len(text[0])
    assert all(text[1][d] == text[0][d] for d in text[1])
    assert Counter((d, t) for d, t in text[2].items()) == Counter({(d, t): n for (d, _, _, t), n in brute_lines(list(text[1].items())).items()})

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    ids = sorted(text[2])
    sets = {d: grams(text[2][d]) for d in ids}
    like = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    label = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if like(sets[a], sets[b])])
    assert text[3] == {d: text[2][d] for d in set(label.values())}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    cut = lambda t: [tuple(w[i : i + 5]) for w in [decontam.tokens(t)] for i in range(len(w) - 4)]
    bad = {d for d, t in text[3].items() for held in [set(cut(t))] for x in items if sum(w in held for w in cut(x)) >= 0.8 * len(cut(x))}
    assert text[4] == {d: t for d, t in text[3].items() if d not in bad}
    check_packing([tuple(r) for r in kept[5].collect()], list(text[4].items()))
    assert kept[2].where("n_chars <> length(text)").count() == 0


def test_stages_take_odd_rows(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, sf_dir)
            got = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if docs is none:
                assert not got
            elif name in ("line_dedup", "decontamination"):
                assert len(got) == 15
            elif name == "near_dedup":
                assert len(got) < 15 and len({(r.doc_id, r.text) for r in got}) == len(got)


@pytest.mark.parametrize("hot", [64, 3])
def test_near_dedup_finds_changed_words(spark, sf_dir, hot):
    """Near copies with a few changed words, by brute force over whole shingle sets; hot lists give the same groups."""
    import random

    from test_llm_operators import groups

    from quern.llm import neardup, simhash

    rng = random.Random(hot)
    vocab = [f"w{i}" for i in range(400)]
    common = rng.choices(vocab, k=30)
    texts = [None, "", " \n", "one two", "one two", "One TWO three"]
    for size in (6, 20, 90, 90, 300):
        base = rng.choices(vocab, k=size) + common * (size == 90)
        for changes in (0, 0, 1, 1, 2, 2, 3, 4, 5):
            w = list(base)
            for at in rng.sample(range(len(w)), min(changes, len(w))):
                w[at] = rng.choice(vocab)
            texts.append(" ".join(w))
    docs = list(enumerate(texts))

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if like(sets[i], sets[j])]
    label = groups(range(len(docs)), pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_groups(df, hot=hot).collect()} == dict(label)
    kept = corpus_pipeline.near_dedup_stage(spark, df, sf_dir)
    assert {r.doc_id for r in kept.collect()} == set(label.values())
    far = [(i, j) for i, j in pairs if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3]
    assert far


def test_shingle_sets_of_any_text():
    """Vectorised cutting gives the words and shingles of each text: short, long, odd, and longer than a chunk."""
    import pyarrow as pa

    from quern.llm import neardup, simhash
    from quern.llm.common import ascii_lower_py

    long = " ".join(f"Wort{i % 1000}" for i in range(200_000))
    texts = ["a b c d e f", "", None, " \n", "A B\tC  d\x0be f", "ÄÖ Ü é ß ñ Ä", "one", "x " * 30, "y" * 70_000 + " b c d e", "Y" * 70_000 + " b c D e", "z" * (neardup._CHUNK + 5) + " " + "a b c d e f", long, "pre " + long, "g h i j k"]
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    got = list(neardup.shingle_sets(column))

    def cut(t):
        w = simhash.WORDS.findall(ascii_lower_py(t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = [cut(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len({*got[i].tolist()} & {*got[j].tolist()}) == len(want[i] & want[j]), (i, j)
    assert all((g[1:] > g[:-1]).all() for g in got)


def test_hot_families_by_brute_force(spark, monkeypatch):
    """Hundreds of near copies of one text, in small blocks: the components of all similar pairs, and no more."""
    import random

    from test_llm_operators import groups

    from quern.llm import neardup

    rng = random.Random(4)
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(260):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 9])):
            w[at] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[20:60] + [f"u{i}-{k}" for k in range(60)]) for i in range(90)]
    cut = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(cut[i] & cut[j]) >= 4 * (len(cut[i]) + len(cut[j]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (64, 8):
        assert {r.doc_id: r.component_id for r in neardup.near_groups(df, hot=hot).collect()} == groups(range(len(texts)), pairs)


def test_common_shingles_thin_in_every_partition_make_no_lists(spark, monkeypatch):
    """Passages of 160 texts, two in each partition, are known as common: they come last in every prefix, so no list is long."""
    from quern.llm import neardup

    def fail(*_):
        raise AssertionError("a list of common shingles was met")

    monkeypatch.setattr(neardup, "_hot_links", fail)
    common = " ".join(f"c{k}" for k in range(16))
    texts = [(i, f"{common} " + " ".join(f"u{i}-{k}" for k in range(20))) for i in range(160)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(texts, 80), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_groups(df, hot=16).collect()} == {i: i for i in range(160)}


def test_near_dedup_links_fingerprints_first(spark, monkeypatch):
    """SimHash fingerprints of the shingle sets, linked at 3 bits as by brute force, come first; the index of shingles adds only what they leave apart."""
    import random

    import numpy as np
    import pyarrow as pa
    from test_llm_operators import groups

    from quern.llm import neardup

    rng = random.Random(8)
    texts = []
    for size in (40, 200, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for changes in (0, 0, 1, 1, 2, 3, 4):
            w = list(base)
            for at in rng.sample(range(size), changes):
                w[at] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(w))
    sets = list(neardup.shingle_sets(pa.array(texts)))
    fps = [neardup._fingerprint(s) & (1 << 64) - 1 for s in sets]
    for s, fp in zip(sets, fps, strict=True):
        assert fp == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    assert neardup._fingerprint(np.zeros(0, np.uint64)) == 0
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    like = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 4 * (len(sets[i]) + len(sets[j]))]
    label, whole = groups(range(len(texts)), [p for p in near if p in like]), groups(range(len(texts)), like)
    assert label != whole and len({*label.values()}) < len({neardup._node(s) for s in sets})
    node = {neardup._node(s): i for i, s in reversed([*enumerate(sets)])}
    calls, verified = [], neardup._verified

    def spy(sets, pairs):
        calls.append([(node[r.a], node[r.b]) for r in pairs.collect()])
        return verified(sets, pairs)

    monkeypatch.setattr(neardup, "_verified", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_groups(df).collect()} == whole
    assert calls[0] and all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in calls[0])
    assert calls[1] and all(label[a] != label[b] for a, b in calls[1])
