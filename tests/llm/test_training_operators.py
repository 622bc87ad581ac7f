"""Every operator against a brute-force version, with null, empty, long and repeated rows and clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import compression_bands, cotraining, decontamination, hpylm, jaccard_join, language_id, license_scan, packing, secret_scan, shared, warc
from webloom.llm.queries import QUERIES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, count long"


def docs(spark, texts, first=0):
    rows = [(None if i < 0 else i, t, ("en", "de", None)[k % 3], None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 1, 2, 3) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(1)), (6, prose(1)), (6, prose(1)), (7, prose(1, 119) + " Xyz"), (8, "é " * 3000), (9, "a b c d e"), (10, "A B c D e"), (-1, prose(1))]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert language_id.identify(none, F.lit(False)).count() == 0
    assert cotraining.quality(none, labels).count() == 0
    assert compression_bands.compression_rules(none).count() == 0
    assert packing.pack(none, *tokenizer()).count() == 0
    assert decontamination.decontaminate(none, bench).count() == 0
    assert license_scan.scan(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert hpylm.score(none, F.lit(False)).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert warc.records(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert decontamination.decontaminate(odd, bench).filter("contaminated").count() == 0


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_words_and_shingles():
    import pyarrow as pa

    texts = [None, "", "a", "A b c\x0bd e f", "x " * 4, "\x1c\x1d y"]
    hashes, counts = shared.hashed_words(pa.array(texts))
    assert counts.tolist() == [len(words(t)) for t in texts]
    sizes = [len(s) for s in shared.shingle_sets(hashes, counts)]
    assert sizes == [len(shingles(t)) for t in texts]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """(shingles, component, links) of each document, comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root, degree = {i: i for i in sets}, Counter()

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                degree.update((a, b))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), degree[i]) for i in sets}


def joined_classes(table, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(table, **options).collect()}


@pytest.mark.parametrize("leaf", [1_000_000, 1500])
def test_jaccard_join(corpus, leaf):
    rows = corpus.select("doc_id", "text").collect()
    assert joined_classes(corpus, leaf_shingles=leaf, pivots=3) == classes([tuple(r) for r in rows])


@pytest.mark.parametrize("leaf", [200, 1_000_000])
def test_jaccard_join_recursion(spark, leaf):
    base = prose(5, 60).split()
    near = [(i, " ".join(base[:30] + [f"w{i}", f"v{i}"] * (i % 4) + base[30:])) for i in range(40)]
    far = [(100 + i, " ".join(base[:14] + prose(i, 5).split())) for i in range(40)]
    chain = [(200 + i, " ".join(prose(77, 100).split()[4 * i : 4 * i + 60])) for i in range(8)]
    got = joined_classes(docs(spark, near + far + chain), leaf_shingles=leaf, pivots=3)
    assert got == classes(near + far + chain)
    assert {got[200 + i][1] for i in range(8)} == {200} and got[200][2] < got[204][2] < 7  # a chain is no clique


def test_regions_split_into_cells_and_blocks(spark, monkeypatch):
    """Clusters that share passages part into cells; one cluster of near copies does not, and is cut into blocks."""
    rng = np.random.default_rng(11)
    pool = [prose(300 + i, 20) for i in range(12)]
    texts = []
    for cluster in range(16):
        own = [pool[p] for p in sorted(rng.choice(12, 6, replace=False))]
        texts += [(1000 * cluster + i, " ".join([*own, f"w{cluster}x{i}"])) for i in range(8)]
    base = prose(400, 100)
    texts += [(50_000 + i, f"{base} tail{i}") for i in range(60)]
    seen, leaves = [], jaccard_join._leaves

    def spy(members, sets, threshold):
        seen.extend(r.region for r in members.select("region").distinct().collect())
        return leaves(members, sets, threshold)

    monkeypatch.setattr(jaccard_join, "_leaves", spy)
    assert joined_classes(docs(spark, texts), leaf_shingles=1200, pivots=8) == classes(texts)
    assert any("/" in r for r in seen) and any("#" in r for r in seen)


def test_jaccard_join_odd(odd):
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: (r.component_id, r.n_links) for r in got}
    assert [by[k] for k in (1, 2, 3, 4)] == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert [by[k] for k in (5, 6, 7, 9, 10)] == [(5, 2), (5, 2), (5, 2), (9, 1), (9, 1)] and by[None] == (None, 0)


def test_batches_add_up_common_shingles():
    rng = np.random.default_rng(5)
    rare = rng.integers(1 << 63, size=4000).astype(np.uint64) << np.uint64(1)
    everywhere = np.array([7 << 50, 3 << 61], np.uint64)  # held by all texts
    sets = [np.unique(np.concatenate([everywhere, rare[10 * i : 10 * i + 14]])) for i in range(390)]
    postings, rows = jaccard_join._by_range(sets, np.uint64(60))
    held = Counter(int(x) for s in sets for x in s)
    six = lambda x: x & ((1 << 48) - 1)
    assert sum(len(r[2]) for r in rows) == 6 * len(held)
    found, several = defaultdict(list), []
    for r, counts, names, times in rows:
        per, values = jaccard_join._from_few(counts), jaccard_join._from_six(names).tolist()
        for d, v in zip(np.repeat(np.arange(len(sets)), per).tolist(), values):
            found[r, v].append(d)
        several += [(r, v, t) for v, t in zip(values[int(per.sum()) :], jaccard_join._from_few(times).tolist() if times else [])]
    told = jaccard_join._from_few(postings).tolist()
    assert told[: len(several)] == [t for _, _, t in several]
    at = len(several)
    for r, v, t in several:
        found[r, v] += told[at : at + t]
        at += t
    assert at == len(told)
    want = defaultdict(list)
    for d, s in enumerate(sets):
        for x in s.tolist():
            want[x >> 60, six(x)].append(d)
    assert found == want


def test_shared_shingles_of_a_common_passage(spark):
    common = prose(900, 40)
    texts = [(i, f"{prose(1000 + i, 30 if i % 3 else 4)} {common} {prose(2000 + i // 2, 20)}") for i in range(240)]
    table = docs(spark, texts).repartition(7)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts for w in [t.translate(LOWER).split()]}
    times = Counter(x for s in sets.values() for x in s)
    alone = {i: sum(times[x] == 1 for x in s) for i, s in sets.items()}
    want = Counter((len(s), alone[i], len(s) - alone[i]) for i, s in sets.items() if 100 * (len(s) - alone[i]) >= 50 * len(s))
    rows = jaccard_join.shared_shingles(table, 5, 50).collect()
    assert want and Counter((r.n, r.uniques, len(r.hashes) // 6) for r in rows) == want
    hot = [set(jaccard_join._from_six(bytes(r.hashes))[-36:].tolist()) for r in rows]
    assert all(h == hot[0] for h in hot)  # the most frequent come last, under the same names in every batch


def test_leaf_counts_a_pair_once():
    sets = [np.arange(20, dtype=np.uint64), np.arange(1, 20, dtype=np.uint64), np.arange(30, 50, dtype=np.uint64), np.arange(2, 20, dtype=np.uint64)]
    leaves = [np.array([3, 7]), np.array([3, 7]), np.array([7]), np.array([7])]
    for rows in (1, 3, 256):
        links, counts = jaccard_join.leaf_links([5, 6, 7, 8], [20, 19, 20, 18], sets, leaves, [1, 10, 1, 100], 7, 75, rows)
        assert sorted(links) == [(6, 5), (8, 5)] and counts.tolist() == [100, 100, 0, 11]


def test_leaf_of_many_members():
    """Postings in pieces give the counts of all pairs."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 4000, 60)).astype(np.uint64) for _ in range(1200)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.05], np.uint64(9999))) for s in sets[:700]]
    sizes = [len(s) for s in sets]
    none = [np.array([1])] * len(sets)
    links, counts = jaccard_join.leaf_links(list(range(len(sets))), sizes, sets, none, [1] * len(sets), 1, 75)
    held = np.zeros((len(sets), 10_000), np.float32)
    for i, s in enumerate(sets):
        held[i, s.astype(int)] = 1
    common = (held @ held.T).astype(int)
    near = 100 * common >= 75 * (np.array(sizes)[:, None] + np.array(sizes) - common)
    np.fill_diagonal(near, False)
    assert counts.tolist() == near.sum(1).tolist() and counts.sum() > 500 and {a for a, _ in links} >= set(np.flatnonzero(near[:, :1].any(1)).tolist())


def test_language_id(corpus, odd):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = language_id.identify(corpus, held).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in got)
    strange = language_id.identify(odd, held).collect()
    assert {r.doc_id for r in strange if r.lang_pred == "und"} >= {1, 2, 3} and len(strange) == len(ODD)


def test_language_sample_is_bounded(spark, corpus):
    """Rows that share a doc_id do not fill the sample; the least frequent labels go beyond the bound on labels."""
    hot = corpus.limit(1).select("text").crossJoin(spark.range(800).select(F.lit(3).cast("long").alias("doc_id"), F.lit("xx").alias("lang")))
    rows = corpus.select("doc_id", "text", "lang").unionByName(hot.select("doc_id", "text", "lang"))
    model = language_id.train(rows, F.lit(True), language_id.Settings(per_language=20))
    assert "xx" in model.labels
    fewer = language_id.train(corpus, F.lit(True), language_id.Settings(languages=2))
    common = [r.lang for r in corpus.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert fewer.labels == sorted(common)


def test_cotraining(spark, corpus, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rng = np.random.default_rng(0)
    y = np.arange(400) % 2
    a, b = (rng.normal(size=(400, 6)).astype(np.float32) for _ in range(2))
    a[:, 0] += 2 * y
    b[:, 1] += 2 * y
    model = cotraining.fit(a[:60], b[:60], y[:60].astype(float), a[60:200], b[60:200], cotraining.Settings(confident=0.8))
    assert np.mean((model.probability(a[200:], b[200:]) > 0.5) == y[200:]) > 0.85
    got = cotraining.quality(corpus, labels).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.9 * len(got)
    assert cotraining.quality(odd, labels.limit(0)).filter("kept").count() == len(ODD)
    assert cotraining.quality(odd, labels).count() == len(ODD)


def two_views(n, share, seed):
    """Rows of a class each, whose views tell it apart independently and with errors."""
    rng = np.random.default_rng(seed)
    y = (np.arange(n) < share * n).astype(float)
    a, b = (rng.normal(size=(n, 8)).astype(np.float32) for _ in range(2))
    a[:, 0] += 2.5 * y
    b[:, 1] += 2.5 * y
    return a, b, y


def test_cotraining_rounds_and_calibration():
    own, pool, new = two_views(2000, 0.5, 1), two_views(2000, 0.8, 2), two_views(8000, 0.8, 3)
    model = cotraining.fit(*own, pool[0], pool[1], cotraining.Settings(rounds=3), prior=0.8)
    assert model.held == (250, 250)
    assert all(model.exchanged[turn, view, q] > 0 for turn in range(3) for view in (0, 1) for q in (0, 1))
    p = model.probability(new[0], new[1])
    bins = np.minimum(9, (10 * p).astype(int))
    error = sum(abs(p[bins == k].mean() - new[2][bins == k].mean()) * np.mean(bins == k) for k in range(10) if (bins == k).any())
    assert error < 0.03 and np.mean((p > 0.5) == (new[2] > 0.5)) > 0.94
    lone = [np.mean((cotraining._sigmoid(s[0] * cotraining._margin(v, w) + s[1]) > 0.5) == (new[2] > 0.5)) for v, w, s in ((new[0], model.text, model.text_platt), (new[1], model.meta, model.meta_platt))]
    assert np.mean((p > 0.5) == (new[2] > 0.5)) > max(lone)
    few = cotraining.fit(own[0][996:1004], own[1][996:1004], own[2][996:1004], pool[0][:0], pool[1][:0], cotraining.Settings())
    assert few.held == (1, 1) and not any(few.exchanged.values())
    assert cotraining.held_back(np.array([0, 0, 0, 1])).sum() == 0


def test_text_view_of_slices():
    raw = np.frombuffer(prose(3, 60_000).encode() * 8, np.uint8)[: (1 << 21) + 77]
    assert len(raw) == (1 << 21) + 77
    whole = cotraining.text_view(raw, 64)
    h = [np.zeros(len(raw), np.uint32)]
    counts = np.zeros(64)
    for n in range(1, 4):
        h.append(h[-1][: len(raw) - n + 1] * np.uint32(0x01000193) ^ raw[n - 1 :].astype(np.uint32) * np.uint32(0x9E3779B1))
        g = (h[-1] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        counts += np.bincount((g ^ (g >> np.uint32(13))) % np.uint32(64), minlength=64)
    want = np.sqrt(counts)
    assert np.allclose(whole, want / np.linalg.norm(want), atol=1e-6)


def test_cotraining_odd_labels(spark, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hot = corpus.limit(1).select("text", "lang", "source", "n_chars").crossJoin(spark.range(500).select(F.lit(-5).cast("long").alias("doc_id")))
    more = corpus.unionByName(hot.select(*corpus.columns)).withColumn("held_out", F.lit(1)).withColumn("quality", F.lit("x"))
    both = labels.unionByName(labels.withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType))).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("text", F.lit(1))
    one = {r.doc_id: round(r.score, 6) for r in cotraining.quality(more, both).collect()}
    assert cotraining.quality(more, both).count() == corpus.count() + 500
    assert set(one.values()) != {0.5}


def test_compression_bands(corpus, odd):
    bands = compression_bands.Bands()
    import zstandard

    for table in (corpus, odd):
        texts = defaultdict(list)
        for r in table.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text)
        for r in compression_bands.compression_rules(table).collect():
            t = texts[r.doc_id][0] or ""
            w = WORD.findall(t)
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines, seen = 0, set()
            for line in t.split("\n"):
                if WORD.search(line):
                    lines += line in seen
                    seen.add(line)
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            verdict = compression_bands.compression(t.encode(), bands, zstandard.ZstdCompressor(level=bands.level))[3]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(repeated), failed, not failed and verdict)
    codec = zstandard.ZstdCompressor(level=3)
    assert not compression_bands.compression(b"ab cd ef " * 2000, bands, codec)[3]
    assert not compression_bands.compression(np.random.default_rng(0).bytes(20000), bands, codec)[3]


def test_compression_bands_encoded_and_templated(spark):
    rng = np.random.default_rng(5)
    wrapped = lambda s: "\n".join(s[i : i + 76] for i in range(0, len(s), 76))
    encoded = {
        "base64": (lambda n: wrapped(base64.b64encode(rng.bytes(n)).decode())[:n], (300, 400, 600, 1100, 4000, 5000, 20000, 100_000)),
        "unbroken hex": (lambda n: rng.bytes(n).hex()[:n], (4700, 5000, 9000, 20000, 100_000)),
        "hex": (lambda n: wrapped(rng.bytes(n).hex())[:n], (4700, 9000, 20000, 100_000)),
        "printable": (lambda n: "".join(chr(c) for c in rng.integers(32, 127, n)), (300, 400, 600, 1100, 4000, 5000, 20000, 100_000)),
        "template": (lambda n: "".join(f"Order {rng.integers(10**6)} from {rng.choice(['Anna', 'Bert', 'Carl'])} was shipped on day {rng.integers(365)}.\n" for _ in range(n // 40))[:n], (1300, 2500, 5000, 20000, 100_000)),
    }
    texts = [(kind, n, make(n)) for kind, (make, sizes) in encoded.items() for n in sizes]
    got = {r.doc_id: r for r in compression_bands.compression_rules(docs(spark, [(i, t) for i, (_, _, t) in enumerate(texts)])).collect()}
    import zstandard

    codec = zstandard.ZstdCompressor(level=3)
    for i, (kind, n, t) in enumerate(texts):
        assert not got[i].kept and not compression_bands.compression(t.encode(), compression_bands.Bands(), codec)[3], (kind, n, got[i].ratio)
    # Of a long dump no base rule rejects, the bands do.
    assert not got[texts.index(next(x for x in texts if x[:2] == ("base64", 20000)))].base_failed


def test_compression_bands_keep_prose(corpus):
    got = compression_bands.compression_rules(corpus).filter("not base_failed").collect()
    assert sum(r.kept for r in got) >= 0.98 * len(got) > 0


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nc", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (6, "u", "é" * 5000), (None, "u", "same"), (7, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")
    chunks = warc.round_trip(pages, chunk_bytes=1000).collect()
    first = {}
    for page, _, body in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        first.setdefault(body or "", page)
    done = [c for c in chunks if c.is_last]
    assert len(done) == len(rows) and max(len(c.data) for c in chunks) == 1000
    bodies = {r[0]: (r[2] or "").encode() for r in rows}
    for c in done:
        raw = bodies[c.page_id]
        assert (c.payload_bytes, c.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()) and c.payload_digest == c.declared_digest
        want = first[raw.decode()] if c.page_id is not None else None
        assert (c.record_type, c.refers_to) == (("response", None) if want in (c.page_id, None) else ("revisit", want))
    record = [c for c in chunks if c.page_id == 5][0]
    own = sorted((c for c in chunks if (c.archive, c.record) == (record.archive, record.record)), key=lambda c: c.chunk)
    assert b"".join(bytes(c.data) for c in own) == bodies[5]
    so_far = b""
    for c in own:
        so_far += bytes(c.data)
        assert c.payload_digest == base64.b32encode(hashlib.sha1(so_far).digest()).decode()


def test_encoder_agrees():
    encode = packing.Encoder(*tokenizer())
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000 and packing.agreed.fullmatch(chr(c))]
    assert len(every) > 30_000
    for c in every:
        text = f"a {c} b{c}{c}c 1{c}  {c}!"
        assert encode.slow.encode(text, add_special_tokens=False).ids == encode.fast.encode_ordinary(text), hex(ord(c))
    rng = np.random.default_rng(1)
    plain = [c for c in every if ord(c) < 0x500]
    for k in range(1500):  # mixtures of all scripts, and of the frequent characters with white space and digits
        own = rng.choice(plain if k % 2 else every, int(rng.integers(1, 60)))
        text = "".join(c + str(rng.choice(["", "", " ", "\n", "  ", "7", "'s"])) for c in own)
        assert encode.slow.encode(text, add_special_tokens=False).ids == encode.fast.encode_ordinary(text), text
    assert encode("a<|endoftext|>b").tolist() == encode.slow.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_packing(spark, corpus, odd):
    encode = packing.Encoder(*tokenizer())
    for table in (corpus, odd.filter("doc_id <> 6")):
        ids = {r.doc_id: [*encode.slow.encode(r.text or "", add_special_tokens=False).ids, 0] for r in table.select("doc_id", "text").collect()}
        rows = packing.pack(table, *tokenizer(), shard_tokens=20_000).collect()
        covered, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            own = ids[r.doc_id]
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
            covered[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        for doc, own in ids.items():
            at = 0
            for start, length in sorted(covered[doc]):
                assert start == at
                at += length
            assert at == len(own)
        padding = 0
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
            padding += 0 if at & (at - 1) == 0 else 1024 - at
        assert padding == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_pack_lengths(lengths):
    out = packing.pack_lengths(np.array(lengths, int), 64)
    used = defaultdict(list)
    for sequence in out:
        assert sum(n for _, _, n in sequence) <= 64
        for i, first, n in sequence:
            used[i].append((first, n))
    for i, n in enumerate(lengths):
        at = 0
        for first, k in sorted(used[i]):
            assert first == at
            at += k
        assert at == n


def test_nnls_uses_exact_fills():
    counts = np.zeros(65, int)
    counts[[40, 24]] = 100
    combos = packing.combinations(np.array([24, 40]), 64)
    assert packing.solve_counts(combos, counts).tolist() == [100]


def contaminated(texts, items):
    """Which items each document holds, by comparing every stretch that some seed hits."""
    word = re.compile(r"[^\W_]+")
    split = lambda t: word.findall((t or "").lower())
    found = defaultdict(set)
    for doc, text in texts:
        d = split(text)
        for item, t in items:
            b = split(t)
            if doc is None or item is None or not b:
                continue
            if len(b) < 5:
                if d == b:
                    found[doc].add(item)
                continue
            for mask in decontamination.MASKS if len(b) >= 10 else decontamination.SHORT:
                taken = [k for k, c in enumerate(mask) if c == "1"]
                for i in range(len(d) - len(mask) + 1):
                    for j in range(len(b) - len(mask) + 1):
                        if all(d[i + k] == b[j + k] for k in taken):
                            f = max(0, min(j - 2, len(b) - 13))
                            own = b[f : f + 13]
                            at = i - j + f
                            equal = sum(0 <= at + k < len(d) and d[at + k] == w for k, w in enumerate(own))
                            if 100 * equal >= 80 * len(own):
                                found[doc].add(item)
    return {k: len(v) for k, v in found.items()}


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    items = [(1, item), (1, item), (2, None), (3, "four words are few"), (4, "six short words stand right here"), (None, item), (5, "exactly five words in here"), (6, "yes"), (7, "nine words make one item that is still short")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, w int")
    w, six, nine = item.split(), items[4][1].split(), items[8][1].split()
    one = lambda own, k: " ".join([*own[:k], "odd", *own[k + 1 :]])
    texts = [
        (1, f"{prose(1)} {item}. {prose(2)}"), (2, prose(3)), (3, prose(1, 5) + " " + " ".join(w[:4] + ["cat"] + w[5:11] + ["an"] + w[12:]) + "!"), (4, "x Six short, words stand right HERE y"),
        (5, "Four words, are few!"), (6, " ".join(w[:6])), (7, item.upper()), (8, None), (9, (item + "\n") * 300), (10, " ".join(x if i % 2 else "zz" for i, x in enumerate(w))), (-1, item),
        (11, "so four words are few"), (12, "yes"), (13, "oh yes"), (9, "no"), (14, ""),
        *((20 + k, f"a {one(six, k)} b") for k in range(6)), *((30 + k, one(items[6][1].split(), k)) for k in range(5)), *((40 + k, f"{one(nine, k)} b") for k in range(9)), (50, one(nine, 2).replace("still", "odd")),
    ]
    table = docs(spark, texts).withColumn("h", F.lit(1)).withColumn("w", F.lit(1)).withColumn("x", F.lit(1)).withColumn("mask", F.lit(1)).withColumn("th", F.lit(1))
    want = contaminated([(i if i >= 0 else None, t) for i, t in texts], items)
    assert {1, 3, 4, 5, 7, 9, 12, *range(20, 26), *range(30, 35), *range(40, 49)} == set(want)
    assert {r.doc_id: r.n_items for r in decontamination.decontaminate(table, bench).filter("contaminated").collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = decontamination.decontaminate(table, bench, broadcast_rows=0)
        assert "BroadcastHashJoin" not in wide._jdf.queryExecution().toString() and {r.doc_id: r.n_items for r in wide.filter("contaminated").collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = decontamination.clean(table, bench)
    assert {r.doc_id for r in kept.collect()} == {i if i >= 0 else None for i, _ in texts} - set(want) and kept.columns == table.columns


def test_decontamination_sql(spark, tmp_path):
    """The SQL tells items of every length as the operator does."""
    import duckdb

    from webloom.llm.queries import ORACLE_SQL

    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary, 1 + k % 14))) for k in range(60)]
    texts = [(k, " ".join([*rng.choice(vocabulary, k % 5), *(x if rng.random() > 0.1 else "z" for x in items[int(rng.integers(60))][1].split())])) for k in range(120)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    con.executemany("insert into benchmark values (?, ?)", items)
    want = {r[0]: r[2] for r in con.sql(ORACLE_SQL["op6_decontamination"]).fetchall()}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_items for r in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    assert got == want == {i: contaminated(texts, items).get(i, 0) for i, _ in texts} and len({v > 0 for v in got.values()}) == 2


def license_of(text):
    """(license, probability, similarity, units) of a text, with no gate: every unit is classified."""
    names, weights, b, temperature, _ = license_scan.train()
    found = []
    lines = [(False, i, p) for i, p in enumerate((text or "").split("\n"))]
    for whole, i, p in lines + [(True, i, p) for i, p in enumerate(re.split(r"\n[ \t\r]*\n", text or "")) if "\n" in p.strip(" ")]:
        grams = license_scan._grams(p)
        own = [weights[g].astype(float) for g in grams if g in weights]
        z = ((np.sum(own, 0) / np.sqrt(max(1, len(own))) if own else 0) + b) / temperature
        family, probability = names[int(z.argmax())], float(1 / np.exp(z - z.max()).sum())
        if family != "none":
            n = len(license_scan._words(p))
            close = max((len(set(grams) & set(t)) / min(n + max(0, n - 1) + max(0, n - 2), len(t)) for f, t in license_scan.templates() if f == family and grams), default=0.0)
            good = family != "unknown" and close >= 0.6
            found.append((good, probability if good else 0.0, -names.index(family), -i, family, probability, close))
    if not found:
        return "none", 0.0, 0.0, 0
    best = max(found)
    return (best[4], round(best[5], 6), round(best[6], 6), len(found)) if best[0] else ("unknown", 0.0, 0.0, len(found))


def test_license_scan(spark, odd, corpus):
    wrapped = "Permission is hereby granted, free of\ncharge, to any person obtaining a copy of this software\nand associated documentation files, to deal in the\nSoftware without restriction."
    texts = [
        (1, "text\nReleased under the MIT License."), (2, "x\n\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."), (5, "The license plate was gone."), (6, prose(4)), (7, None), (8, ""), (9, "All rights reserved."), (10, "Released under the MIT License.\n" * 400),
        (11, "Available under CC BY 4.0."), (12, "Distributed under the terms of GPLv3 or later."), (13, "Code released under Apache-2.0"), (14, "CC0 1.0 Universal"), (15, "GPLv3 applies to this file"),
        (16, "Creative Commons Attribution 4.0 International"), (17, "A public library in the town is open today."), (18, "Permission to speak was given."), (19, f"{prose(7)}\n\n{wrapped}\n \n{prose(8)}"),
        (20, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), (21, "Licensed under the Zork Software License."), (22, "This work is under Creative Commons Attribution-NonCommercial 4.0 International."),
        (23, prose(5, 3000) * 60), (24, prose(5, 3000) * 60 + "\nReleased under the MIT License.\n" + prose(6, 3)), (25, "MIT License\nMIT License"),
    ]
    table = docs(spark, texts).withColumn("gram", F.lit(1)).withColumn("w", F.lit(1)).withColumn("size", F.lit(1)).withColumn("line", F.lit(1))
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    want = {1: "mit", 2: "apache", 3: "gpl", 4: "cc-by-nc", 5: "unknown", 6: "none", 7: "none", 8: "none", 9: "proprietary", 10: "mit", 11: "cc-by", 12: "gpl", 13: "apache", 14: "public-domain", 15: "gpl", 16: "cc-by", 17: "none", 18: "none", 19: "mit", 20: "bsd", 21: "unknown", 22: "cc-by-nc", 23: "none", 24: "mit", 25: "mit"}
    assert {i: r.license for i, r in got.items()} == want
    for own, found in ((texts, got), ([tuple(r) for r in corpus.select("doc_id", "text").collect()], {r.doc_id: r for r in license_scan.scan(corpus).collect()})):
        for i, text in own:
            r = found[i]
            assert (r.license, r.n_paragraphs) == license_of(text)[::3]
            assert (r.probability, r.similarity) == pytest.approx(license_of(text)[1:3], abs=1e-5)
    assert license_scan.scan(odd).count() == len(ODD)


def test_license_training():
    assert license_scan.held_out_accuracy() > 0.85
    names, weights, b, _, _ = license_scan.train()
    told = set(license_scan.telling_words())
    # The gate changes no answer: without a telling word there is no weight, and the answer is none.
    assert all(told & set(g.split()) for g in weights) and names[int(b.argmax())] == "none"
    gate = re.compile(license_scan._telling_pattern())
    assert all(gate.search(w) and gate.search(f"x {w}, y") for w in told) and not gate.search("xmitx")


def base_spans(t):
    t = t or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in sorted(out)]


SECRETS = [
    (1, "token:secret:abcdefghij password = 'abcdefgh' API_KEY:\"x.y=z/+-_1\" tokenx=12345678"), (2, "é AKIA" + "A" * 12 + " AKIAB AKIA" + "B" * 11), (3, "f" * 31 + " " + "0a" * 16 + "G" + "b" * 40), (4, None), (5, ""),
    (6, "AKIA" + "Z" * 16 + " then " + "aB3/" * 10 + " user_id=joe"), (7, "x " + "aB3/" * 10 + " alone"), (8, "AKIA" + "Z" * 16 + " " * 900 + "aB3/" * 10), (9, "see https://a.io/x only"), (-1, "passwd=12345678"), (6, "AKIA" + "Z" * 16 + " then " + "aB3/" * 10 + " user_id=joe"), (10, "secret=" + "q" * 100_000),
]


def test_secret_scan(spark, corpus):
    for table in (docs(spark, SECRETS), corpus):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        got = secret_scan.scan(table).collect()
        assert len(got) == table.count()
        for r in got:
            want = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
            assert set(want) <= set(r.spans.split(",")) | ({""} if want else set())
    by = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, SECRETS)).collect()}
    assert "secret:" in by[6] and "identifier:" in by[6] and "secret" not in by[7] and "secret:" not in by[8] and by[9] == "" and by[5] == ""


def test_secret_after_equals_sign(spark):
    key, secret = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = [
        (1, f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={secret}\nREGION=x"), (2, f"[default]\nid = {key}\nsk={secret}"), (3, f"GET https://a.io/x?client_id=web1&sig={secret}&v=2"),
        (4, f"KEY={secret}"), (5, f"{key} sum={secret}="), (6, f"{key} sum={secret}A"), (7, f"client_id=web1 SK={secret} https://a.io/x"),
    ]
    table = docs(spark, texts)
    spans = {r.doc_id: r.spans.split(",") for r in secret_scan.scan(table).collect()}
    for i, t in texts:
        at = t.index(secret)
        assert (f"secret:{at}:{at + 40}" in spans[i]) == (i in (1, 2, 3, 7)), i
    assert [x.split(":")[0] for x in spans[7]] == ["identifier", "secret", "endpoint"]
    clean = {r.doc_id: r.text for r in secret_scan.redact(table).collect()}
    assert clean[1] == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]\nREGION=x" and clean[4] == texts[3][1]
    assert all(secret not in clean[i] for i in (1, 2, 3, 7))


def all_spans(t, scope=240):
    """Base spans, and weak ones beside a complementary part, comparing all pairs."""
    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t))]
    weak = {
        "secret": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
        "identifier": r"""(?:client|account|user|tenant)_?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
        "endpoint": r"""https?://[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~/%-]*)?|[a-z0-9.-]+\.amazonaws\.com""",
    }
    weak = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "", re.I if k == "identifier" else 0)] for k, p in weak.items()}
    strong = {k: [(a, b) for n, a, b in base if n == k] for k in ("assign", "access", "hex")}
    near = lambda s, others: any(o[0] - s[1] <= scope and s[0] - o[1] <= scope for o in others)
    proven = [s for s in weak["identifier"] if near(s, weak["secret"])]
    out = [("secret", *s) for s in weak["secret"] if near(s, strong["access"] + weak["identifier"] + weak["endpoint"])]
    out += [("identifier", *s) for s in weak["identifier"] if near(s, weak["secret"] + strong["assign"])]
    out += [("endpoint", *s) for s in weak["endpoint"] if near(s, strong["access"] + proven)]
    order = ("assign", "access", "hex", "secret", "identifier", "endpoint")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(((a, order.index(k), b) for k, a, b in base + out)) for k in (order[k],))


def test_linking_against_all_pairs(spark, corpus):
    rng = np.random.default_rng(6)
    code = lambda n: "".join(rng.choice(list("ABCabc0189+/"), n))
    parts = (lambda: "AKIA" + "Q7" * 8, lambda: code(40), lambda: "client_id=web7", lambda: "user name joe", lambda: "Account_Name: bob.x", lambda: "https://a.io/x%20y?z", lambda: "s3.eu.amazonaws.com", lambda: "secret: " + code(9), lambda: "0f" * 16, lambda: "é" * int(rng.integers(1, 300)), lambda: prose(int(rng.integers(9999)), int(rng.integers(1, 60))))
    texts = [(k, " ".join(parts[int(rng.integers(len(parts)))]() for _ in range(int(rng.integers(1, 14))))) for k in range(150)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, texts)).collect()}
    assert got == {i: all_spans(t) for i, t in texts} and sum("endpoint" in s for s in got.values()) > 5
    whole = {r.doc_id: r.text for r in corpus.collect()}
    assert {r.doc_id: r.spans for r in secret_scan.scan(corpus).collect()} == {i: all_spans(t) for i, t in whole.items()}


def test_redaction_with_clashing_columns(spark):
    table = docs(spark, SECRETS)
    more = table
    for name in ("h", "all", "th0", "th", "d", "t", "row", "doc", "new", "strong", "weak", "x.y"):
        more = more.withColumn(name, F.lit(f"own {name}"))
    got = secret_scan.redact(more)
    assert got.columns == more.columns and all(r[c] == f"own {c}" for r in got.collect() for c in more.columns if c not in table.columns)
    assert sorted(map(repr, got.select(*table.columns).collect())) == sorted(map(repr, secret_scan.redact(table).collect()))
    assert dict(got.dtypes) == dict(more.dtypes) and secret_scan.redact(table.drop("n_chars")).count() == len(SECRETS)


def test_redaction(spark):
    got = {r.doc_id: r for r in secret_scan.redact(docs(spark, SECRETS)).collect()}
    assert got[-1 if -1 in got else None].text == "[SECRET]" and got[4].text is None and got[9].text == SECRETS[8][1]
    assert got[6].text == "[SECRET] then [SECRET] [SECRET]" and got[6].n_chars == len(got[6].text)
    assert got[3].text == "f" * 31 + " [SECRET]G[SECRET]"


def test_hpylm(corpus, odd):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    for table in (corpus, odd):
        rows = table.select("doc_id", "text").collect()
        tokens = [[*words(r.text), None] for r in rows]
        train = [i for i, r in enumerate(rows) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10]
        c = Counter(w for i in train for w in tokens[i])
        n, v = sum(c.values()), len(c)
        want = sorted((r.doc_id or -1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, t in zip(rows, tokens))
        got = hpylm.score(table, held).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score <= 0 for r in got)
    both = {r.held_out: r for r in hpylm.perplexity(hpylm.score(corpus, held)).collect()}
    assert both[True].perplexity < both[True].base_perplexity


def model_of(spark, texts, settings):
    """The states of a model of the texts, and by state the restaurants, the root's dishes and the context dishes."""
    table = docs(spark, list(enumerate(texts))).select("doc_id", "text", F.lit(False).alias("held_out"))
    grid = hpylm._Grid(3, 2, 2)
    packed = hpylm._fixed(hpylm._packed_rows(table, grid), 4, "rng")
    states, kept = hpylm._sampled(packed, grid, 4, settings)
    found, told = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        found[r.rng].append(r.asDict())
    for r in kept.collect():
        told[r.batch, r.rng].append(r.asDict())
    out = []
    for k in range(len(states)):
        contexts, root, dishes = {}, {}, defaultdict(dict)
        for number, own in found.items():
            if not any(r["kind"] == hpylm._PAIRS for r in own):
                continue
            part = hpylm._Range(own)
            kept_seats = next(r for r in told[k, number] if r["kind"] == hpylm._SEATS)
            seats = hpylm.Seats.read(kept_seats["a"], kept_seats["b"])
            assert seats.customers().tolist() == part.customers[part.customers > 1].tolist()
            tables = (part.customers > 0).astype(int)
            tables[part.customers > 1] = seats.tables()
            i, j = divmod(number, grid.columns)
            answers = [r for r in told[k, number] if r["kind"] == hpylm._ANSWER]
            customers = grid.told(told[-1, number], 0, "a")
            contexts.update({(i, u): x for u, *x in zip(part.us.tolist(), customers.tolist(), grid.told(answers, 0, "b").tolist())})
            root.update({(j, w): x for w, *x in zip(part.ws.tolist(), grid.told(answers, 1, "b").tolist(), grid.told(answers, 1, "c").tolist())})
            for u, w, c, t in zip(part.us[part.u].tolist(), part.ws[part.w].tolist(), part.customers.tolist(), tables.tolist()):
                dishes[i, u][j, w] = (c, t)
        out.append((contexts, root, dishes))
    return states, out


def test_hpylm_states_are_consistent_and_sum_to_one(spark):
    rng = np.random.default_rng(2)
    names = [f"w{k}" for k in range(60)]
    texts = [" ".join(names[min(59, k)] for k in rng.zipf(1.4, 200)) for _ in range(20)]
    states, found = model_of(spark, texts, hpylm.Settings())
    tokens = [[None, *words(t), None] for t in texts]
    counted = Counter(p for t in tokens for p in zip(t, t[1:]))
    for state, (contexts, root, dishes) in zip(states, found):
        every = [x for own in dishes.values() for x in own.values()]
        assert len(contexts) == len(root) == state.vocabulary and sorted(c for c, _ in every) == sorted(counted.values())
        assert sum(c for c, _ in root.values()) == state.root_customers and sum(t for _, t in root.values()) == state.root_tables
        assert all(1 <= t <= c for c, t in [*root.values(), *every])
        p = {w: float(state.root(c, t)) for w, (c, t) in root.items()}
        unheard = float(state.root(0, 0))
        assert sum(p.values()) + unheard == pytest.approx(1, abs=1e-9)
        for w, (c, _) in root.items():  # the root's customers are the tables below
            assert c == sum(own[w][1] for own in dishes.values() if w in own)
        for u, (c, t) in contexts.items():
            own = dishes[u]
            assert (c, t) == tuple(np.sum(list(own.values()), axis=0))
            mass = sum(state.predictive(*own.get(w, (0, 0)), c, t, p[w]) for w in root) + state.predictive(0, 0, c, t, unheard)
            assert mass == pytest.approx(1, abs=1e-9)


def table_odds(customers, parent, strength, discount):
    """Exact distribution of the tables of a restaurant with one dish, by summing over all seatings in turn."""
    odds = {1: 1.0}
    for n in range(1, customers):
        after = defaultdict(float)
        for t, x in odds.items():
            after[t] += x * (n - discount * t)
            after[t + 1] += x * (strength + discount * t) * parent
        odds = after
    total = sum(odds.values())
    return {t: x / total for t, x in odds.items()}


@pytest.mark.parametrize(("customers", "parent"), [(2, 0.3), (5, 0.05), (12, 0.4)])
def test_gibbs_reaches_the_exact_distribution(customers, parent):
    """Many restaurants with one dish each: reseating forgets the start and ends at the exact odds."""
    many, rng = 8_000, np.random.default_rng(1)
    for start in (np.full(many, customers), np.ones(many * customers, int)):  # one table, or a table for each
        seats = hpylm.Seats(np.repeat(np.arange(many), len(start) // many), start.copy(), many)
        tables = seats.tables().astype(float)
        seats.reseat(np.full(many, parent), np.arange(many), tables, 1.0, 0.6, rng, 40 * customers)
        assert (seats.customers() == customers).all() and (seats.tables() == tables).all() and (seats.size > 0).all()
        share = np.bincount(seats.tables(), minlength=customers + 1) / many
        for t, x in table_odds(customers, parent, 1.0, 0.6).items():
            assert share[t] == pytest.approx(x, abs=0.025)


def test_first_seats():
    rng = np.random.default_rng(0)
    want = np.array([0, 1, 2, 1000, 50_000_000])
    seats = hpylm.Seats.none(5)
    seats.grow(want, np.array([1.0, 1.0, 0.0, 1.0, 3.0]), 0.5, rng)
    assert seats.customers().tolist() == want.tolist() and seats.tables()[:3].tolist() == [0, 1, 1] and (seats.size > 0).all()
    assert hpylm.Seats.read(*seats.written()).size.tolist() == seats.size.tolist()
    less = np.array([0, 0, 1, 10, 40_000_000])
    seats.shrink(less, rng)
    assert seats.customers().tolist() == less.tolist() and (seats.size > 0).all()
    seats.grow(want, np.ones(5), 0.5, rng)
    assert seats.customers().tolist() == want.tolist()


def test_hpylm_tells_contexts_apart(spark):
    """Learned pairs of words are likelier than the same words otherwise; a text seen twice than one held out."""
    rng = np.random.default_rng(4)
    names = [f"w{k}" for k in range(300)]
    texts = [(i, " ".join(names[k] for k in rng.integers(0, 300, 60))) for i in range(100)]
    more = [(200, prose(9, 80)), (201, prose(9, 80)), (300, prose(10, 80)), (301, " ".join(reversed(texts[5][1].split()))), (302, texts[5][1])]
    got = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(docs(spark, texts + more), F.col("doc_id") >= 300).collect()}
    assert got[302] > got[301] + 0.3 and got[200] == got[201] > got[300] + 0.5


def test_hpylm_tells_longer_contexts_apart(spark):
    """The word before decides, the previous word alone is the same everywhere."""
    rng = np.random.default_rng(8)
    texts = [(k, " ".join(f"x{i} m y{i}" for i in rng.integers(0, 20, 20))) for k in range(100)]
    more = [(300, " ".join(f"x{i} m y{i}" for i in range(20))), (301, " ".join(f"x{i} m y{(i + 1) % 20}" for i in range(20)))]
    got = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(docs(spark, texts + more), F.col("doc_id") >= 300).collect()}
    assert got[300] > got[301] + 0.5


def test_hpylm_of_two_words_is_consistent_and_sums_to_one(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(24, k)}" for k in rng.zipf(1.5, 60)) for _ in range(12)]
    table = docs(spark, list(enumerate(texts))).select("doc_id", "text", F.lit(False).alias("held_out"))
    grid = hpylm._Grid(2, 2, 2)
    packed = hpylm._fixed(hpylm._packed_rows(table, grid, 2), 4, "rng")
    states, kept = hpylm._sampled(packed, grid, 4, hpylm.Settings())
    found, told = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        found[r.rng].append(r.asDict())
    for r in kept.collect():
        told[r.batch, r.rng].append(r.asDict())
    tokens = [[None, None, *words(t), None] for t in texts]
    triples = Counter(x for t in tokens for x in zip(t, t[1:], t[2:]))
    contexts = Counter(x for t in tokens for x in zip(t, t[1:-1]))
    for k, state in enumerate(states):
        deep, pairs, root, ones, twos = defaultdict(dict), defaultdict(dict), {}, {}, {}
        for number, own in found.items():
            if not any(r["kind"] == hpylm._PAIRS for r in own):
                continue
            part, (i, j) = hpylm._Range(own), divmod(number, grid.columns)
            seats = next(r for r in told[k, number] if r["kind"] == hpylm._SEATS)
            below = part.tables(seats["f"], part.served > 1, part.served)
            assert hpylm.Seats.read(seats["f"], seats["g"]).customers().tolist() == part.served[part.served > 1].tolist()
            tables, customers = part.tables(seats["a"], part.customers > 1, part.customers), part.by_pair(below)
            answers = [r for r in told[k, number] if r["kind"] == hpylm._ANSWER]
            counts = [r for r in told[-1, number] if r["kind"] == hpylm._COUNTS]
            ones.update({(i, u): x for u, *x in zip(part.us.tolist(), grid.told(answers, 0, "c").tolist(), grid.told(answers, 0, "b").tolist())})
            twos.update({(i, c): x for c, *x in zip(part.contexts.tolist(), grid.told(counts, 2, "a").tolist(), grid.told(answers, 2, "b").tolist())})
            root.update({(j, w): x for w, *x in zip(part.ws.tolist(), grid.told(answers, 1, "b").tolist(), grid.told(answers, 1, "c").tolist())})
            for u, w, c, t in zip(part.us[part.u].tolist(), part.ws[part.w].tolist(), customers.tolist(), tables.tolist()):
                pairs[i, u][j, w] = (c, t)
            for c, at, n, t in zip(part.contexts[part.k].tolist(), part.at.tolist(), part.served.tolist(), below.tolist()):
                deep[i, c, int(part.us[part.u[at]])][j, int(part.ws[part.w[at]])] = (n, t)
        assert sorted(n for own in deep.values() for n, _ in own.values()) == sorted(triples.values())
        assert sorted(c for c, _ in twos.values()) == sorted(contexts.values()) and len(deep) == len(twos)
        p = {w: float(state.root(c, t)) for w, (c, t) in root.items()}
        assert sum(p.values()) + float(state.root(0, 0)) == pytest.approx(1, abs=1e-9)
        assert all(c == sum(own[w][1] for own in pairs.values() if w in own) for w, (c, _) in root.items())
        for (i, c, u), own in deep.items():
            assert twos[i, c] == np.sum(list(own.values()), axis=0).tolist() and all(1 <= t <= n for n, t in own.values())
            assert ones[i, u] == np.sum(list(pairs[i, u].values()), axis=0).tolist()
            parent = lambda w, p, i=i, u=u: state.predictive(*pairs[i, u].get(w, (0, 0)), *ones[i, u], p)
            mass = sum(state.predictive(*own.get(w, (0, 0)), *twos[i, c], parent(w, p[w]), deep=True) for w in root)
            assert mass + state.predictive(0, 0, *twos[i, c], parent(None, float(state.root(0, 0))), deep=True) == pytest.approx(1, abs=1e-9)
        for (i, u), own in pairs.items():  # a dish's customers are the tables of all contexts that end in its word
            for w, (c, _) in own.items():
                assert c == sum(x[w][1] for (row, _, of), x in deep.items() if (row, of) == (i, u) and w in x)


@pytest.mark.parametrize("before", [1, 2])
def test_hpylm_merges_batches(spark, before):
    """Ranges of merged rows are those of the batches' rows, which find their triples in them, and take fewer bytes."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{min(400, k)}" for k in rng.zipf(1.3, 200)) for _ in range(40)]
    table = docs(spark, list(enumerate(texts))).select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("held_out")).repartition(8)  # a batch for each
    grid, common = hpylm._Grid(2, 3, 2), shared.hashed_words(pa.array(["nowhere " + " ".join(f"w{k}" for k in range(1, 300))]))[0]
    plain, short = ([r.asDict() for r in sorted(hpylm._packed_rows(table, grid, before, c).collect(), key=lambda r: (r.kind, r.batch, r.rng))] for c in (None, common))
    size = lambda rows: sum(len(r[c]) for r in rows for c in "abcdefgh" if r[c])
    assert len({r["batch"] for r in plain}) > 5 and size(short) < 0.9 * size(plain)
    for number in range(grid.ranges()):
        was, now = [r for r in plain if r["rng"] == number], [r for r in short if r["rng"] == number]
        merged = [dict(zip(("rng", "slot", "batch", "kind", *"abcdefgh", "x"), r)) for r in hpylm._merged(number, now, grid, hpylm._Common(common, grid))]
        assert size(merged) < size(now) and [r for r in merged if r["kind"] == hpylm._HOME] == [r for r in now if r["kind"] == hpylm._HOME]
        old, new = hpylm._Range(was, keep_places=True), hpylm._Range(merged, keep_places=True)
        assert all((getattr(old, c) == getattr(new, c)).all() for c in ("us", "ws", "u", "w", "served", "customers", *(("contexts", "k", "at") if before == 2 else ())))
        places = [new.places[hpylm._words(r["a"])] for r in sorted((r for r in merged if r["kind"] == hpylm._PLACES), key=lambda r: r["batch"])]
        assert np.concatenate(places).tolist() == old.places.tolist()


def test_hpylm_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(500).select(F.col("id").cast("int").alias("rng"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in hpylm._ROW.split(", ")[1:])))
    before = files()
    tables = [hpylm._fixed(rows, 4, "rng"), hpylm._stored(rows.repartition(3, "rng"), "rows")[0]]
    assert files() <= before and [t.count() for t in tables] == [500, 500]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("webloom")]


def test_hpylm_without_training(odd):
    got = hpylm.score(odd, F.lit(True)).collect()
    assert all(r.base_score == pytest.approx(0, abs=1e-9) and r.score == pytest.approx(0, abs=1e-9) and r.train_tokens == 0 for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    current = docs_in
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.materialize(stage(spark, current, SF), name)
        assert out.columns == docs_in.columns and 0 < out.count() <= current.count()
        if name == "ngram_jaccard_join":
            left = classes([tuple(r) for r in current.select("doc_id", "text").collect()])
            assert {r.doc_id for r in out.collect()} == {c for _, c, _ in left.values()}
        if name == "secret_scans":
            assert not any(base_spans(r.text) for r in out.collect())
        current = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == current.count()


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11)) and "pipeline" in QUERIES
