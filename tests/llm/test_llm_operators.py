import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontam, langid, licenses, linededup, media, packing, quality, sharding, simhash, urlfilter
from quern.llm.common import ascii_lower_py
from quern.llm.components import connected_components
from quern.llm.queries import QUERIES, vocabulary


def rows(df):
    return [tuple(r) for r in df.collect()]


def groups(ids, linked):
    """Smallest reachable id by union-find, ``linked`` being pairs."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# media ---------------------------------------------------------------------------------------------------------------


def test_media_contract(spark, odd, odd_rows, none):
    got = media.text_media(odd).collect()
    assert len(got) == len(odd_rows)
    want = Counter()
    for d, t in odd_rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes == r.payload_bytes + 44 and r.feature.startswith("audio/wav;") and "corrected=true" in r.feature for r in got)
    assert media.text_media(none).count() == 0


def test_wav_round_trip():
    for payload in (b"", b"\xff", bytes(range(256)) * 5):
        assert media.from_wav(media.to_wav(payload)) == payload


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2" * 2)) + chunk(b"IEND", b"")


def flac_file(bodies, total=None):
    def crc(data, poly, bits):
        c = 0
        for x in data:
            c ^= x << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        return c.to_bytes(bits // 8, "big")

    out = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 192, 192) + b"\0" * 6 + ((8000 << 44) | (192 * len(bodies) if total is None else total)).to_bytes(8, "big") + b"\0" * 16
    for i, body in enumerate(bodies):
        head = bytes([0xFF, 0xF8, 0x10, 0x00, i])
        head += crc(head, 0x07, 8)
        out += head + body + crc(head + body, 0x8005, 16)
    return out


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 62, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + b"\0" * 8
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x00\x12\xff\x00\x34\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    ogg = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
    flac = flac_file([b"ab", b"cdefg"])
    mp4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"mdat")
    tiff = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 256, 3, 1, 5, 0)
    return {
        "image/png": png(), "application/zip": z.getvalue(), "application/gzip": gz.compress(b"hello") + gz.flush(), "image/bmp": bmp, "image/gif": gif,
        "image/jpeg": jpeg, "application/pdf": pdf, "application/ogg": ogg, "audio/flac": flac, "video/mp4": mp4, "image/tiff": tiff, "audio/wav": media.to_wav(b"abcd"),
    }


@pytest.mark.parametrize("kind", sorted(samples()))
def test_sniff_confirms_and_refuses(kind):
    data = samples()[kind]
    assert [p for p in media.sniff(data) if p.offset == 0] == [media.Part(kind, 0, len(data))]
    assert not [p for p in media.sniff(data[:-1]) if p.kind == kind]  # cut short
    inside = media.sniff(b"junk" + data + b"tail" * 3)
    assert media.Part(kind, 4, len(data)) in inside


def test_flac_frames_confirm_the_length():
    data = flac_file([bytes(random.Random(i).randbytes(300)) for i in range(20)])
    assert media.sniff(data + b"trailing bytes") == [media.Part("audio/flac", 0, len(data))]
    assert media.sniff(flac_file([b"x" * 50] * 4, total=0)) != [] and not media.sniff(data[:-400])
    broken = bytearray(data)
    broken[200] ^= 1
    assert not media.sniff(bytes(broken))


def test_archives_of_many_entries_take_linear_time():
    import time

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("inner.zip", samples()["application/zip"])
        for i in range(16_000):
            f.writestr(f"{i}", b"x" * 200)
    data, inner = z.getvalue(), samples()["application/zip"]
    began = time.process_time()
    got = media.sniff(data)
    assert time.process_time() - began < 0.5
    assert got == [media.Part("application/zip", 0, len(data)), media.Part("application/zip", data.index(inner), len(inner))]
    pages = (b"OggS\0\0" + b"\0" * 20 + b"\x01\x03abc") * 20_000 + samples()["application/ogg"]
    assert media.sniff(pages) == [media.Part("application/ogg", 0, len(pages))]


def test_sniff_media_corrects_and_carves(spark):
    carrier = media.to_wav(b"..." + png() + b"...")
    df = spark.createDataFrame([(1, bytearray(carrier), "image/bmp"), (2, bytearray(b"BM PK\3\4 no file"), "x"), (3, None, "x"), (4, bytearray(b""), None)], "id long, content binary, declared string")
    got = {r.id: r for r in media.sniff_media(df, declared="declared").collect()}
    assert (got[1].detected, got[1].corrected, got[1].valid_bytes) == ("audio/wav", True, len(carrier))
    assert [(p.kind, p.offset, bytes(p.bytes)) for p in got[1].carved] == [("image/png", 47, png())]
    assert (got[2].detected, got[2].carved) == ("application/octet-stream", []) and got[3].detected is None and got[4].corrected is False


# line dedup ----------------------------------------------------------------------------------------------------------


def brute_lines(pairs, least=20, docs=3):
    low = -(1 << 63)
    holders = defaultdict(set)
    for d, t in pairs:
        for line in (t or "").split("\n"):
            k = linededup.line_key(line)
            if len(k) >= least:
                holders[k].add(low if d is None else d)
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := linededup.line_key(x)) < least or len(holders[k]) < docs or max(holders[k]) == (low if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [26, 10])
def test_line_dedup(odd, odd_rows, docs, spark, none, bits):
    """A filter of any size, a full one too, gives the same rows."""
    for df, pairs in ((odd, odd_rows), (spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), [d[:2] for d in docs])):
        out = linededup.dedup_lines(df.select("doc_id", "text"), log2_bits=bits)
        assert Counter(rows(out.select("doc_id", "__lines", "__dropped", "__kept"))) == brute_lines(pairs)
    assert linededup.dedup_lines(none, log2_bits=bits).count() == 0


def test_line_dedup_keeps_columns_of_any_name_and_takes_any_key(spark, sf_dir):
    import corpus_pipeline

    line, other = "a line that several documents hold", "the footer of a number of pages"
    texts = [(1, f"x\n{line}\ny"), (2, f"{line.upper()}  \n{other}"), (3, line), (None, f"{other}\n\n{line}"), (4, other), (5, None), (5, "alone"), (3, line)]
    texts.append((6, "\n".join(f"{line}\nrow {i}" for i in range(20_000))))
    names = ["__th", "__doc", "__len", "__drop", "doc", "th", "len", "drop", "body", "c0", "mark"]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    want = brute_lines(texts)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "__kept", "__lines", "__dropped"]
    assert Counter(rows(out.select("doc_id", "__lines", "__dropped", "__kept"))) == want
    assert {tuple(r) for r in out.select(*names).collect()} == {tuple(range(len(names)))}
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = linededup.dedup_lines(named).select(F.substring("doc_id", 2, 9).cast("long"), "__lines", "__dropped", "__kept")
    assert Counter(rows(got)) == want
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, df, sf_dir)
        assert left.columns == df.columns and {tuple(r) for r in left.select(*names).collect()} == {tuple(range(len(names)))}, name


def test_twice_filter_has_no_false_negatives():
    a, b = linededup._Pair(16), linededup._Pair(16)
    keys = [f"key {i} of some length" for i in range(2000)]
    for pair in (a, b):
        pair.add(linededup._slots(keys, 16))
    twice = a.twice | b.twice | (a.once & b.once)
    s = linededup._slots(keys, 16)
    assert ((twice[s >> 3] & (1 << (s & 7)).astype(np.uint8)) != 0).all()


# language ------------------------------------------------------------------------------------------------------------


def test_language_id(spark, sf_dir, docs):
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf_dir).collect()}
    truth = {d: x for d, _, x in docs}
    assert len(got) == len(docs) and {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2} == {d for d, r in got.items() if r.held_out}
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def brute_kneser_ney(texts):
    """p(c | a, b) of one language by the textbook, with dictionaries."""
    tri = Counter()
    for t in texts:
        tri.update(langid.trigrams(t).tolist())
    bits = 21
    two = Counter(k & ((1 << 2 * bits) - 1) for k in tri)
    one = Counter(k & ((1 << bits) - 1) for k in two)

    def discount(c):
        n = Counter(c.values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    d3, d2, d1 = discount(tri), discount(two), discount(one)

    def p1(c):
        total = sum(one.values())
        return max(one[c] - d1, 0) / total + d1 * len(one) / total / langid.symbols()

    def p2(b, c):
        mine = {k: n for k, n in two.items() if k >> bits == b}
        total = sum(mine.values())
        return max(two[b << bits | c] - d2, 0) / total + d2 * len(mine) / total * p1(c) if total else p1(c)

    def p3(a, b, c):
        mine = {k: n for k, n in tri.items() if k >> bits == a << bits | b}
        total = sum(mine.values())
        return max(tri[a << 2 * bits | b << bits | c] - d3, 0) / total + d3 * len(mine) / total * p2(b, c) if total else p2(b, c)

    return p3


WORDS = {"en": "the cat sat on the mat with a hat", "fr": "le chat est sur la table, déjà", "ru": "кот сидит на столе", "zh": "猫坐在桌子上 我喜欢猫", "ja": "ねこはテーブルの上にいます"}


def test_language_model_by_brute_force(spark):
    df = spark.createDataFrame([(t, x) for x, t in WORDS.items()] * 3, "text string, lang string")
    m = langid.fit(df)
    assert m.langs == sorted(WORDS)
    for j, x in enumerate(m.langs):
        p = brute_kneser_ney([WORDS[x]] * 3)
        for t in [*WORDS.values(), "unseen zebra äöü 漢字"]:
            keys = langid.trigrams(t)
            want = [p(k >> 42, k >> 21 & (1 << 21) - 1, k & (1 << 21) - 1) for k in keys.tolist()]
            assert np.exp(m.logp(keys)[:, j]) == pytest.approx(want, rel=1e-3)
            assert m.entropy(t)[0][j] == pytest.approx(-np.log(want).mean(), rel=1e-4)
    for x, t in WORDS.items():
        assert m.predict(t)[0] == x  # no script is folded into another


def test_language_model_is_a_distribution(spark):
    m = langid.fit(spark.createDataFrame([(t, x) for x, t in WORDS.items()] * 3, "text string, lang string"))
    every = np.unique(langid._table())
    for a, b in ((20, 8), (0, 12), (langid._table()[ord("猫")], langid._table()[ord("坐")]), (200_000, 26)):
        p = np.exp(m.logp((np.int64(a) << 42) | (np.int64(b) << 21) | every).astype(float))
        assert p.sum(0) == pytest.approx(1, abs=1e-3)


def test_language_rejection(spark, sf_dir):
    """Languages and noise that were not learned are rejected, held-out texts of the learned ones hardly ever."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), key="doc_id")
    held = [m.predict(r.text) for r in docs.where("crc32(cast(doc_id as string)) % 4 = 2 and length(text) > 200").collect()]
    assert np.mean([r[2] for r in held]) < 0.03
    strange = ["Це зовсім інша мова, якої модель ніколи не бачила раніше", "猫坐在桌子上，我喜欢猫和狗", "xq zzkw qqvx jjkx wvvq xzzq kkqj vxqz", "Ez egy teljesen más nyelv, amelyet a modell soha nem látott", "Αυτή είναι μια άλλη γλώσσα"]
    assert [m.predict(t)[2] for t in strange] == [True] * 5


def test_language_odd(odd, none):
    m = langid.fit(odd)
    got = rows(langid.identify(odd, m))
    assert len(got) == 15 and sum(r[1] == "und" for r in got) == 4
    assert langid.identify(none, m).count() == 0
    nothing = langid.fit(none)
    assert all(r[1:] == ("und", 0.0, True) for r in rows(langid.identify(odd, nothing)))


# near duplicates -----------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = simhash.WORDS.findall(ascii_lower_py(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(pairs):
    fps = [brute_fingerprint(t) for _, t in pairs]
    n = range(len(pairs))
    label = groups(n, [(i, j) for i in n for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = defaultdict(list)
    for i in n:
        if pairs[i][0] is not None:
            low[label[i]].append(pairs[i][0])
    return Counter((pairs[i][0], f"{fps[i]:016x}", min(low[label[i]], default=None)) for i in n)


def test_simhash(odd, odd_rows, docs, spark, none):
    for df, pairs in ((odd, odd_rows), (spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), [d[:2] for d in docs])):
        pairs = [(d, t) for d, t in pairs]
        out = simhash.simhash_groups(df).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id")
        assert Counter(rows(out)) == brute_groups(pairs)
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize(("k", "hot"), [(3, 1024), (5, 1024), (3, 2)])
def test_links_by_any_index_and_hot_lists(spark, k, hot):
    """The inverted index finds every pair; hot posting lists give the same components."""
    rng = random.Random(k * hot)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & ((1 << 64) - 1) for c in centers for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(df, k=k, hot=hot).collect()}
    if hot > 12:
        assert got == want
    assert got <= want and groups(signed, got) == groups(signed, want)


@pytest.mark.parametrize("k", [3, 5])
def test_byte_sets_cover(k):
    from itertools import combinations

    assert all(any(set(s) <= set(five) for s in simhash._byte_sets(k)) for five in combinations(range(8), 5))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = dict(rows(connected_components(df)))
    want = groups({x for p in chain for x in p}, chain)
    assert got == {k: v for k, v in want.items() if k != 200}
    assert connected_components(df.limit(0)).count() == 0


# url filters ---------------------------------------------------------------------------------------------------------


LINK = '<html><head><link href="{}" rel="canonical"></head>'


def url_pages():
    link = LINK
    return [
        (1, "https://a.example.NET/en/x?y#z", None), (2, "http://b.net/q", ""), (3, "http://c.example.org/fr/1", "x"), (4, "http://example.com/de/1", ""),
        (5, "http://x.example.org/en/", link.format("http://bad.net/p")), (6, "http://y.example.org/en/", link.format("//x.example.org/en/")),
        (7, "http://z.example.org/1", link.format("http://bad.net/2")), (8, "http://z.example.org/fr/9", link.format("/1")),
        (9, "http://w.example.org/a/b", "<meta http-equiv=refresh content='0; url=c'>"), (10, "http://w.example.org/a/c", link.format("https://t.net/")),
        (11, None, link.format("http://t.net/")), (12, "no scheme", None), (None, "HTTP://Q.ORG", None), (2, "http://b.net/q", ""), (13, "http://notnet/", None),
    ]


def test_urls(spark):
    pages = url_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("node", F.lit(1))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "/q", "net/", "block"), (3, "c.example.org", "/fr/1", "org/fr/", "allow"),
        (4, "example.com", "/de/1", "example.com/de/", "block"), (5, "x.example.org", "/en/", None, "block"), (6, "y.example.org", "/en/", None, "block"),
        (7, "z.example.org", "/1", None, "allow"), (8, "z.example.org", "/fr/9", "org/fr/", "allow"), (9, "w.example.org", "/a/b", None, "block"),
        (10, "w.example.org", "/a/c", None, "block"), (11, "", "", None, "allow"), (12, "", "", None, "allow"), (None, "q.org", "", None, "allow"), (13, "notnet", "/", None, "allow"),
    }
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    hops = spark.createDataFrame([("http://one.org/a", "http://two.org/b"), ("http://two.org/b", "http://three.net/"), (None, "http://x.org/")], "src string, dst string")
    page = spark.createDataFrame([(1, "http://one.org/a")], "page_id long, url string")
    assert urlfilter.filter_urls(page, html=None, redirects=hops).first().verdict == "block"
    assert urlfilter.filter_urls(page, html=None).first().verdict == "allow"


def test_url_sql_on_made_links(spark, tmp_path):
    """The SQL finds the same links, either order of attributes, relative targets and refreshes, and the same groups; very long pages too."""
    import duckdb

    from quern.llm.queries import SQL

    rng = random.Random(3)
    hosts = ["a.net", "b.org", "example.com", "c.example.net", "d.info", "E.Info"]
    forms = ["<link rel=canonical href={}>", "<LINK href='{}' REL=\"canonical\" />", '<meta content="5; URL={}" http-equiv="refresh">', "<meta http-equiv=refresh content='0;url={}'>", "<link rel=icon href={}>", "{}"]
    pages = url_pages()
    for i in range(300):
        target = rng.choice(["http://{}/{}", "https://{}/en/{}?x#y", "//{}/{}", "/{1}", "{1}", "?q={1}", "../{1}&amp;b=1"]).format(rng.choice(hosts), rng.randrange(60))
        url = rng.choice(["http://{}/{}", "https://{}/de/{}", "http://{}/fr/{}", "http://{}"]).format(rng.choice(hosts), rng.randrange(60))
        pages.append((100 + i, url, "<html>" + " filler" * (200_000 if i == 7 else 3) + rng.choice(forms).format(target) + "</html>" if rng.random() < 0.3 else None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect())
    c = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    c.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    want = c.sql(SQL["op5_url_filters"])
    order = [want.columns.index(x) for x in ("page_id", "host", "path", "rule", "verdict")]
    assert got == Counter(tuple(r[i] for i in order) for r in want.fetchall())
    none = Counter(r.verdict for r in urlfilter.filter_urls(df, html=None).collect())
    assert none != Counter(r[4] for r in got.elements())  # links did move verdicts


# quality -------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    """On the middle table, as the smallest has few labels: the held-out fold is told apart."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op6_quality_classifier"](spark, sf).collect()]
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    good = [r for r in held if label[r.doc_id] == 1]
    assert np.mean([r.predicted for r in good]) > 0.97
    assert np.mean([r.score for r in good]) > np.mean([r.score for r in held if label[r.doc_id] == 0]) + 0.3


def brute_features(text):
    """The n-grams of a text, one by one, as feature numbers."""
    big = 1 << 64
    slot = lambda g: (g * 0x9E3779B97F4A7C15) % big >> 46
    shape = quality._shape_table()
    c, out = [ord(x) for x in text], set()
    s = [int(shape[min(x, 0x2FFF)]) for x in c]
    for i in range(len(c)):
        one = c[i] + 1
        out.add(slot(one))
        if i + 1 < len(c):
            two = (one * 0x1F123BB5 + c[i + 1] + 1) % big
            out.add(slot(two))
            if i + 2 < len(c):
                out.add(slot((two * 0x2545F491 + c[i + 2] + 1) % big))
        if i + 4 < len(c):
            out.add(slot(sum(s[i + k] << 3 * (4 - k) for k in range(5)) + (1 << 40)))
    words = text.split()
    for i in range(len(words) - 7):
        out.add(slot(sum((words[i + k] not in words[: i + k]) << (7 - k) for k in range(8)) + (1 << 41)))
    return sorted(out)


def test_quality_by_brute_force(spark, docs):
    """Features one by one, ratios by counting, and a hinge loss whose duality gap has closed."""
    texts = ["", "a", "Ab 1!", "one two three four five six seven eight one two\n" * 3, *[t or "" for _, t, _ in docs[:40]]]
    for t in texts:
        assert quality.features(t).tolist() == brute_features(t)
    y = [i % 2 for i in range(len(texts))]
    model = quality.fit(spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, y, strict=True))], "doc_id long, text string, quality int"), key="doc_id")
    n, c = [y.count(0), y.count(1)], [Counter(), Counter()]
    for t, v in zip(texts, y, strict=True):
        c[v].update(brute_features(t))
    for k in {*c[0], *c[1]}:
        assert model.ratio[k] == pytest.approx(np.log((c[1][k] + 1) / (n[1] + 2) / ((c[0][k] + 1) / (n[0] + 2))), abs=1e-6)
    f = [quality.features(t) for t in texts]
    v = [r / max(np.sqrt((r * r).sum()), 1e-12) for r in (model.ratio[i] for i in f)]
    sign = np.array([1.0 if x else -1.0 for x in y])
    w, b = quality.dual_descent(f, v, sign, quality.SIZE, epochs=500)
    x = np.zeros((len(f), quality.SIZE + 1))
    for i in range(len(f)):
        x[i, f[i]], x[i, -1] = v[i], 1
    full = np.append(w, b)
    primal = full @ full / 2 + np.maximum(0, 1 - sign * (x @ full)).sum()
    k = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(len(f))  # the same problem by projected gradient steps
    for _ in range(20_000):
        alpha = np.clip(alpha - (k @ alpha - 1) / np.linalg.norm(k, 2), 0, 1)
    assert primal == pytest.approx(alpha.sum() - alpha @ k @ alpha / 2, rel=0.01)
    held = model.score(texts[-1])
    assert held == pytest.approx(1 / (1 + np.exp(-(model.slope * (model.weight[f[-1]].sum() / np.sqrt((model.ratio[f[-1]] ** 2).sum()) + model.bias) + model.shift))))


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows_, vals, y = [], [], []
    for i in range(200):
        label = 1.0 if i % 2 else -1.0
        rows_.append(np.array([0 if label > 0 else 1, 2 + rng.integers(5)]))
        vals.append(np.array([1.0, 0.2]))
        y.append(label)
    w, b = quality.dual_descent(rows_, vals, np.array(y), 8)
    assert all(np.sign(w[i] @ v + b) == t for i, v, t in zip(rows_, vals, y, strict=True))


def test_quality_odd(odd, none):
    labels = odd.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") == 7, None).otherwise(0))
    model = quality.fit(labels)
    got = rows(quality.score(odd, model))
    assert len(got) == 15 and all(0 <= r[1] <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    assert rows(quality.score(odd, quality.fit(labels.limit(0))))[0][1] == pytest.approx(0.5)


# decontamination -----------------------------------------------------------------------------------------------------

ITEM = "If Anna walks 5 km in 40 minutes and then rests for 10 minutes, how far does Anna walk in 2 hours at that pace?"


def test_decontamination(spark, docs, sf_dir):
    import duckdb

    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    cut = lambda t: [tuple(w[i : i + 5]) for w in [decontam.tokens(t)] for i in range(len(w) - 4)]
    held = {d: set(cut(t)) for d, t, _ in docs}
    want = {(d, i) for i, t in items for d in held if sum(w in held[d] for w in cut(t)) >= 0.8 * len(cut(t))}
    got = {tuple(r)[:2] for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_reparameterised(spark):
    other = ITEM.replace("Anna", "Bert").replace("5 km", "7 miles").replace("40", "90").replace("10 m", "20 m").replace("2 hours", "3 hours")
    broken = ITEM.replace("rests", "Bert rests").replace("does Anna", "does Carl").replace("If Anna", "If Dora")
    prose = "He said that the weather was fine and went out to buy bread for 5 people in 10 minutes"
    texts = [(1, "Intro words. " + ITEM), (2, "Question: " + other), (3, prose), (4, ITEM.upper()), (5, None), (6, ""), (None, other), (1, ITEM), (7, " ".join(["so"] * 50_000) + " " + other), (8, "5 km 40 minutes 10")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("h", F.lit(0))
    items = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, None), (2, ""), (3, "5 km 40"), (4, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(df, items).collect()}
    assert got == {(1, 0): "literal", (2, 0): "template", (4, 0): "literal", (None, 0): "template", (7, 0): "template"}
    assert not rows(decontam.contaminated(df.limit(0), items)) and not rows(decontam.contaminated(df, items.limit(0)))
    mixed = spark.createDataFrame([(1, other.replace("does Bert", "does Carl").replace("far does", "far does"))], "doc_id long, text string")
    assert [r.kind for r in decontam.contaminated(mixed, items).collect()] in ([], ["template"])
    assert broken


def test_decontamination_finds_exchanged_names_at_sentence_starts(spark):
    tom = "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"
    maria = "Maria keeps 12 hens near the river. Maria sells 5 eggs to every guest. Maria then walks home with 7 coins. How many coins did the guests of the farm pay?"
    items = spark.createDataFrame([(1, tom), (2, maria)], "item_id long, text string")
    swap = lambda t, a, b: t.replace(a, b).replace("3", "8").replace("12", "30").replace("5", "6")
    mixed = swap(tom, "Tom", "Bob").replace("does Bob", "does Jack")  # one name, two values
    docs = [(1, swap(tom, "Tom", "Bob")), (2, "Some prose before it. " + swap(maria, "Maria", "Sophie") + " And after."), (3, "Nothing of the kind. Tom has left."), (4, mixed)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(df, items).collect()}
    assert got == {(1, 1): "template", (2, 2): "template"}


def test_windows_of_many_texts_are_those_of_each(docs):
    texts = ["Mr. Smith paid $5 to Anna, and 12km with McDonald; Émile Zola saw 3,000.5 km % 7 dollars_a b\tC. Dora ran 4 miles", "one Two three Four five, Six", *[t for _, t, _ in docs if t]]
    texts = [t for t in texts if len(decontam.tokens(t)) >= 5]
    seen = decontam.Words()
    held = [seen.cut(t) for t in texts]
    ids = np.concatenate([x for _, i, _ in held for x in (i, [0])])
    inner = np.concatenate([x for _, _, g in held for x in (g, [False])])
    got = [(int(p), kind, int(h)) for kind, hs, _, at in seen.windows(ids, inner, True) for p, h in zip(at, hs.view(np.int64), strict=True)]
    want, start = [], 0
    for t, (words, _, _) in zip(texts, held, strict=True):
        want += [(start + p, kind, h) for p, kind, h, _ in decontam._windows_of(t, decontam.Hasher())]
        start += len(words) + 1
    assert Counter(got) == Counter(want)


def brute_contaminated(doc, item, least=0.8):
    """'literal', 'template' or None for one document and item, window by window."""
    n_of = lambda toks: range(max(1, len(toks) - 4)) if toks else range(0)
    lit, mine = decontam.tokens(doc), decontam.tokens(item)
    cut = lambda toks, i: tuple(toks[i : i + 5])
    held = {cut(lit, i) for i in n_of(lit)}
    literal = {i for i in n_of(mine) if cut(mine, i) in held}
    good = set(literal)
    for initial in (False, True):
        (dt, ds), (it, its) = decontam.template(doc, initial), decontam.template(item, initial)
        slotted = lambda sl, i: 0 < sum(x is not None for x in sl[i : i + 5]) < len(sl[i : i + 5])
        ways = defaultdict(list)
        for i in n_of(it):
            for p in n_of(dt):
                if slotted(its, i) and cut(it, i) == cut(dt, p):
                    ways[p - i].append((i, p))
        for hits in ways.values():
            value = defaultdict(set)
            for i, p in hits:
                for a, b in zip(its[i : i + 5], ds[p : p + 5], strict=True):
                    if a is not None:
                        value[a].add(b)
            torn = [a for a, v in value.items() if len(v) > 1]
            if len(torn) <= 1 and all(a.startswith("n:") for a in torn):
                good |= {i for i, _ in hits}
    n = len(n_of(mine))
    return None if not n or len(good) < least * n else "literal" if len(literal) >= least * n else "template"


def test_templates_by_brute_force_and_recall(spark):
    """Questions with other names, numbers and units are found wherever these stand; clean texts are left alone."""
    rng = random.Random(5)
    names = "Anna Bert Carla David Emma Frank Greta Hugo Irene Jonas Mr. Mrs.".split()
    forms = [
        "{a} has {n} apples. {a} buys {m} more. How many apples does {a} have after {k} {u}?", "A train from the north runs {n} {v} in {m} {u}. How far does it run in {k} {u} at that speed?",
        "Mr. {a} sold {n} tickets and {b} sold {m} tickets. {b} kept {k} of them. How many tickets did Mr. {a} and {b} sell together?", "If {a} walks {n} {v} in {m} {u} and then rests for {k} {u}, how far does {a} walk in all?",
        "{a} and {b} share {n} marbles. {a} gets {m} marbles more than {b}. How many marbles does each of them get?", "In a shop {a} pays {n} dollars for {m} pens, while {b} pays {k} dollars. Who pays less for a pen?",
    ]

    def fill(form):
        a, b = rng.sample(names[:10], 2)
        return form.format(a=a, b=b, n=rng.randrange(2, 99), m=rng.randrange(2, 99), k=rng.randrange(2, 99), u=rng.choice(["minutes", "hours"]), v=rng.choice(["km", "miles"]))

    items = [(i, fill(f)) for i, f in enumerate(forms)]
    clean = "The committee met on Monday and {a} spoke about {n} roads. Then {b} walked {m} {v} home. It took {k} {u}."
    texts = [(i, "Some words before. " * rng.randrange(3) + fill(forms[i % 6]) + " And after.", i % 6) for i in range(60)] + [(100 + i, fill(clean), None) for i in range(20)]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): k for d, t, _ in texts for i, x in items if (k := brute_contaminated(t, x))}
    assert got == want
    assert sum((d, i) in got for d, _, i in texts[:60]) >= 54 and not [k for k in got if k[0] >= 100]


# licences ------------------------------------------------------------------------------------------------------------


def brute_licences(text):
    """Findings (line, family) and the number of unknown passages, by splitting a text in Python."""
    import regex

    m, found, unknown, at = licenses.trained(), [], 0, 0
    for piece in regex.split(licenses._CUT, text or "", flags=regex.V1):
        if any(g in piece.lower() for g in licenses.GATE):
            line = at + piece[: len(piece) - len(piece.lstrip())].count("\n")
            got = m.judge(piece)
            found += [(line, f) for f in sorted(got)]
            unknown += not got
        at += piece.count("\n")
    return found, unknown


BSD = """# Redistribution and use in source and binary forms, with or
# without modification, are permitted provided that the following
# conditions are met:"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
MIT = """Copyright (c) 2019 Someone

Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction."""


def test_licences(spark, odd, none):
    texts = [
        (1, "Words.\nReleased under the MIT License."), (2, "All rights reserved. " + "of the and to " * 2000), (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "A driving licence is needed to drive."), (6, None), (7, ""), (8, "plain prose about MIT"),
        (9, "Some words\n\n" + BSD + "\n1. Redistributions of source code"), (10, GPL), (11, MIT), (12, "Dual licensed under the MIT License or the Apache License, Version 2.0."), (13, "Not licensed under the MIT License."),
        (14, "Shared under CC BY-NC-ND 4.0."), (15, "Licensed under GPL-3.0"), (16, "Code is available under the Apache 2.0 licence."), (17, "It isn't released under the GNU GPL version 2."),
    ]
    got = {r.doc_id: r for r in licenses.scan_licences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = {
        1: ["MIT"], 2: ["proprietary"], 3: ["Apache-2.0", "CC-BY-NC"], 4: ["GPL-3.0"], 5: [], 6: [], 7: [], 8: [], 9: ["BSD"], 10: ["GPL-3.0"], 11: ["MIT"], 12: ["Apache-2.0", "MIT"], 13: [],
        14: ["CC-BY-NC-ND"], 15: ["GPL-3.0"], 16: ["Apache-2.0"], 17: [],
    }
    assert {d: r.families for d, r in got.items()} == want
    assert got[1].findings[0].line == 1 and got[5].n_unknown == 1 and got[9].findings[0].line == 2
    for d, t in texts:
        assert (sorted((f.line, f.family) for f in got[d].findings), got[d].n_unknown) == (sorted(brute_licences(t)[0]), brute_licences(t)[1]), d
    clash = odd.withColumns({"families": F.lit(1), "all": F.lit(2), "key": F.lit(3), "x": F.lit(4)})
    assert licenses.scan_licences(clash).count() == 15 and licenses.scan_licences(none).count() == 0


def test_licence_scan_by_brute_force(spark, docs):
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    for r in licenses.scan_licences(df).collect():
        text = next(t for d, t, _ in docs if d == r.doc_id)
        assert (sorted((f.line, f.family) for f in r.findings), r.n_unknown) == (sorted(brute_licences(text)[0]), brute_licences(text)[1])


def test_licence_expression_equals_python(spark):
    m = licenses.trained()
    texts = sorted({t for t, _, _ in licenses.training()})
    cut = {s[: 2 * len(s) // 3] for _, s in licenses.SIGNATURES}
    assert all(any(g in t.lower() for g in licenses.GATE) for t, fs, _ in licenses.training() if fs and t not in cut)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses._judge(licenses._grams(F.col("t")), m).alias("j"), licenses._grams(F.col("t")).alias("g"))
    for r in df.collect():
        assert sorted(r.g) == licenses.grams_py(r.t)
        want = m.judge(r.t)
        assert {j.family: j.score for j in r.j} == pytest.approx(want, abs=1e-4)


def test_licences_in_unseen_wordings():
    """Recall and false findings in phrases that the model has not seen; none of the test tables' phrases is needed."""
    assert licenses.trained().recall > 0.8
    m = licenses.trained(frozenset(["Released under the {}.", "Released under {}", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}."]))
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    assert {t: list(m.judge(t)) for t in lines} == {t: [f] for t, f in lines.items()}
    new = ["This document may be used under the terms of the {}", "Our sources are published under the {}.", "Files are distributed under the {}", "made available under the {} by its authors"]
    no = ["The {} is never mentioned again.", "This was not published under the {}.", "A lecture on the {} took place on Monday", "These sources are not available under the {}."]
    names = [(f, n) for f, ns in licenses.NAMES.items() for n in ns]
    m = licenses.trained()
    assert np.mean([f in m.judge(p.format(n)) for p in new for f, n in names]) > 0.9
    assert np.mean([bool(m.judge(p.format(n))) for p in no for _, n in names]) < 0.15


# sharding ------------------------------------------------------------------------------------------------------------


def brute_table(names, slots):
    prefer = []
    for s in names:
        h = hashlib.md5(s.encode()).digest()
        a, b = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1
        prefer.append([(a + k * b) % slots for k in range(slots)])
    table, left = {}, slots
    while left:
        for i, order in enumerate(prefer):
            if left:
                table[next(s for s in order if s not in table)] = i
                left -= 1
    return [table[s] for s in range(slots)]


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(names, 503)
    assert t == brute_table(names, 503)
    share = Counter(t)
    assert max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(names[:-1], 503)
    moved = sum(a != b for a, b in zip(t, less, strict=True) if a != 6)
    assert moved < 0.3 * 503
    assert Counter(sharding.lookup_table({"a": 1, "b": 3}, 503))[1] == pytest.approx(377, abs=2)
    for bad in (lambda: sharding.lookup_table([], 7), lambda: sharding.lookup_table(["a"], 8), lambda: sharding.lookup_table(["a", "a"], 7)):
        with pytest.raises(ValueError):
            bad()


def test_place(spark, odd, none, tmp_path):
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 101)
    got = sharding.place(odd, names, slots=101).collect()
    assert len(got) == 15
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(none, names).count() == 0
    hot = spark.range(3000).select(F.lit(1).alias("k"), "id")
    assert sharding.place(hot, names, "k").select("shard").distinct().count() == 1
    assert sharding.place(hot, names, "k", salt="id", salts=16).select("shard").distinct().count() == 3
    placed = sharding.place(spark.range(500).withColumnRenamed("id", "doc_id"), names)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


# packing -------------------------------------------------------------------------------------------------------------


def check_packing(got, pairs, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = Counter()
    for d, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), sum(r[3] for r in got)


def test_packing(odd, odd_rows, docs, spark, none):
    check_packing(rows(packing.pack(odd, vocabulary())), odd_rows)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(5)
    n, total = check_packing(rows(packing.pack(df, vocabulary())), [d[:2] for d in docs])
    assert n <= -(-total // 2048) * 1.03 + 1
    assert packing.pack(none, vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), rng.lognormal(5, 1, 3000).clip(1, 2048).astype(int), rng.integers(600, 900, 3000), np.full(3000, 700)][seed]
    counts = Counter(lengths.tolist())
    bins = packing.plan(dict(counts), 2048)
    held = Counter()
    for b in bins:
        assert sum(b.lengths) <= 2048 and b.count > 0
        for n in b.lengths:
            held[n] += b.count
    assert held == counts
    best_fit = sum(b.count for b in packing._best_fit([], dict(counts), 2048))
    assert sum(b.count for b in bins) <= 1.011 * best_fit
    assert packing.plan({}, 2048) == []
    with pytest.raises(ValueError):
        packing.plan({4000: 1}, 2048)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_placements_come_from_configurations(sf):
    """On the lengths of real documents: large pieces keep their configurations to the end, close to the lower bound."""
    import pyarrow.parquet as pq

    tok, counts = packing.tokenizer(vocabulary()), Counter()
    for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0):
        n = len(tok.ids(t.as_py())) // 4 + 1
        counts.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    bins, rest = packing.configured(dict(counts), 2048, 192, 0.35, 1 / 16)
    large = sum(c for n, c in counts.items() if n > 0.35 * 2048)
    assert sum(c for n, c in rest.items() if n > 0.35 * 2048) <= max(3, 0.05 * large)
    final = packing.plan(dict(counts), 2048)
    assert sum(b.count for b in final) <= -(-sum(n * c for n, c in counts.items()) // 2048) + 1
    left = Counter()
    for b in bins:
        left[b.lengths] += b.count
    for b in sorted(final, key=lambda b: -len(b.lengths)):
        for k in range(len(b.lengths), 0, -1):
            if left[b.lengths[:k]] > 0:
                left[b.lengths[:k]] -= b.count
                break
    assert not +left and min(left.values()) >= 0


def test_word_tokenizer_forgets():
    tok = packing.WordTokenizer(vocabulary(), size=8)
    for text in ("one two three four five six", "seven eight nine ten one", "one <|endoftext|> don't it's 123 $%& ÀÉ ß", "a\x0bb c Å İ"):
        assert tok.ids(text) == np.array(tok.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
