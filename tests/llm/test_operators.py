"""Operators beyond their contract queries, on small inputs against plain Python."""

from __future__ import annotations

import hashlib
import io
import itertools
import os
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, decontam, linededup, mixing, pii, quality, secrets, simhash, warc
from sluice.llm.convnet import windows_of


def frame(spark, rows, tmp_path, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    """Rows as a Parquet table, as operators get it."""
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("cut", [1, 777, 5000, 1 << 20])
def test_warc_ranges_return_each_record_once(cut):
    inner = b"".join(warc.gzip_member(warc.record_bytes(900 + i, None, os.urandom(50), "0" * 64, None, "d"), 5) for i in range(3))
    payloads = [os.urandom(3000) if i % 3 or cut < len(inner) else inner + b"tail" for i in range(20)]
    data = b"".join(warc.gzip_member(warc.record_bytes(i, "u", p, hashlib.sha256(p).hexdigest(), None, "d"), 0 if i % 3 == 0 else 5) for i, p in enumerate(payloads))
    got = [warc.to_row(h, b, True) for s in range(0, len(data), cut) for h, b in warc.read_range(io.BytesIO(data), len(data), s, min(len(data), s + cut))]
    own = [g for g in got if g[0] < 900]
    assert [(g[0], g[6]) for g in own] == list(enumerate(payloads))


def test_warc_damage(tmp_path):
    members = [warc.gzip_member(warc.record_bytes(i, "u", b"p" * 500, hashlib.sha256(b"p" * 500).hexdigest(), None, "d"), 5) for i in range(6)]
    members[2] = members[2][:20] + b"\0\0\0\0" + members[2][24:]
    data = b"".join(members)
    assert [warc.to_row(h, b, False)[0] for h, b in warc.read_range(io.BytesIO(data), len(data), 0, len(data))] == [0, 1, 3, 4, 5]


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_links_in_crowded_buckets(spark):
    base = 0x0123456789ABCDEF
    fps = {base}
    for i in range(40):
        fps |= {base ^ (1 << i), base ^ (1 << i) ^ (1 << (i * 7 % 60)), base ^ (7 << (i % 50)) ^ (1 << 63)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for limit in (2, 16, 1000):
        edges = simhash.links(df, 2, limit)
        for r in edges.collect():
            assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 2
        comp = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
        want = brute_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
        assert {f: comp.get(f, f) for f in signed} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def jaccard(a, b):
    s = lambda t: {t.lower()[i : i + 5] for i in range(len(t) - 4)}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def test_line_dedup(spark, tmp_path):
    words = [f"word{i * 7919 % 1000} token{i}" for i in range(60)]
    long = " ".join(words)
    near = [long.replace(f"token{k}", f"tokex{k}") for k in range(0, 40, 2)]
    rows = [(1, f"{long}\nshort\nunique line number one of document", "en", "s", 0), (2, f"short\n{near[0]}\n\n{long}", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(10 + k, f"own text of document {k} {hashlib.md5(str(k).encode()).hexdigest()}\n{n}", "en", "s", 0) for k, n in enumerate(near)]
    rows.append(rows[-1])
    got = [r.asDict() for r in linededup.dedup(frame(spark, rows, tmp_path)).collect()]
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] == rows[0][1] and text[2] == "short\n" and text[3] is None and text[4] == ""
    assert all(n not in (r["text"] or "") for r in got for n in near)
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    kept = [x for r in got for x in (r["text"] or "").split("\n") if len(x.strip()) >= linededup.MIN_CHARS]
    assert all(jaccard(a, b) < 0.8 for i, a in enumerate(kept) for b in kept[:i])
    assert len(kept) == 2 + len(near)


def linked(spark, texts, buckets):
    """Components of the texts in the given buckets, and what all pairs of each bucket make."""
    lines = spark.createDataFrame(list(enumerate(texts)), "h bigint, line string").withColumn("s", F.size(linededup.shingled(F.col("line"))))
    members = spark.createDataFrame([(k, h) for k, b in enumerate(buckets) for h in b], "key bigint, h bigint")
    comp = {r["node"]: r["root"] for r in common.connected_components(linededup.line_links(common.stored(members), common.stored(lines), 0.8)).collect()}
    met = {frozenset(p) for b in buckets for p in itertools.combinations(b, 2)}
    want = brute_components(range(len(texts)), lambda a, b: frozenset((a, b)) in met and jaccard(texts[a], texts[b]) >= 0.8)
    return {h: comp.get(h, h) for h in want}, want


def test_line_links_of_pairs_that_share_one_key(spark):
    text = lambda k, more: " ".join(hashlib.md5(f"{k}-{j}".encode()).hexdigest()[:9] for j in range(12)) + more
    texts = [text(k, "") for k in range(80)] + [text(k, " changed") for k in range(1, 79)]
    got, want = linked(spark, texts, [range(len(texts))])
    assert got == want and len(set(want.values())) == 80


def test_line_links_of_drifting_copies(spark):
    texts = []
    for c in range(12):
        words = [hashlib.md5(f"{c}-{j}".encode()).hexdigest()[:7] for j in range(24)]
        for k in range(10):
            words[k * 2] = f"step{k}x{c}"
            texts.append(" ".join(words))
    import random

    random.Random(3).shuffle(texts)
    got, want = linked(spark, texts, [range(len(texts)), range(0, len(texts), 2), range(70)])
    assert got == want and len(set(want.values())) == 12


def test_line_keys_without_blanks(spark):
    """Copies with one character changed near the start share a key, other lines that begin alike don't."""
    urls = ["https://example.org/" + "".join(hashlib.sha256(f"{k}-{j}".encode()).hexdigest() for j in range(3)) for k in range(40)]
    texts = urls + [f"{u[:3]}#{u[4:]}" for u in urls]
    keys = [set(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(linededup.band_keys(F.col("t"))).collect()]
    assert all(jaccard(a, b) >= 0.9 for a, b in zip(urls, texts[40:], strict=True))
    assert sum(bool(keys[k] & keys[40 + k]) for k in range(40)) >= 38
    assert sum(bool(keys[a] & keys[b]) for a, b in itertools.combinations(range(40), 2)) <= 8


def test_mixing_is_fair(spark, tmp_path):
    weights, blocks = [5, 3, 2], [500, 300, 200]
    slots = mixing.schedule(weights, blocks)
    assert sorted(slots) == sorted((s, b) for s, n in enumerate(blocks) for b in range(n))
    given = Counter()
    for t, (s, b) in enumerate(slots, 1):
        assert b == given[s]
        given[s] += 1
        if t < 990:
            assert all(abs(given[x] - t * w / 10) < 1 for x, w in enumerate(weights))
    rows = [(i, "x", "en", None if i % 7 == 0 else "hot" if i % 3 else "cold", 1) for i in range(500)]
    got = mixing.mix(frame(spark, rows, tmp_path), {"hot": 2, "cold": 1}, block_rows=8).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(500)) and sorted(r["doc_id"] for r in got) == list(range(500))


def test_decontamination(spark, odd_dir, tmp_path):
    items = pq.read_table(f"{odd_dir}/benchmark.parquet").to_pylist()
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    bench = spark.read.parquet(f"{odd_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    exact = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if decontam.contains(decontam.words_of(d["text"]), decontam.words_of(i["text"]))}
    assert exact and len(exact & got) >= 0.9 * len(exact)
    left = {r["doc_id"] for r in decontam.clean(docs, bench).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


@pytest.mark.parametrize("n", [400, 2100])
def test_decontamination_of_many_items(spark, tmp_path, n):
    """Items cut from documents of their own, planted word for word and with 28 % of the words replaced."""
    import random

    rng = random.Random(n)
    words = [w.decode() for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in decontam.words_of(t)]

    def cut(k):
        at = rng.randrange(len(words) - k)
        return words[at : at + k]

    items = [cut(rng.randrange(16, 60)) for _ in range(n)]
    rows = []
    for k, item in enumerate(items):
        edited = [rng.choice(words) if rng.random() < 0.28 else w for w in item]
        rows += [(2 * k + e, " ".join(cut(rng.randrange(90)) + held + cut(rng.randrange(90))), "en", "s", 1) for e, held in enumerate((item, edited))]
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(spark, rows, tmp_path), bench).collect()}
    for edited, least in ((0, 0.995), (1, 0.97)):
        want = set()
        for i, text, *_ in rows[edited::2]:
            item, text = decontam.words_of(" ".join(items[i // 2])), decontam.words_of(text)
            if decontam.lcs(item, text) >= decontam.MIN_LCS * len(item):
                want.add((i, i // 2))
        assert len(want) > n / 4 and len(want & got) >= least * len(want), (edited, len(want), len(want & got))


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(5)]) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert decontam.lcs(a, b) == plain(a, b)


def test_quality_drops_the_odd_one_of_its_group(spark, tmp_path):
    rows = [(i, " ".join(f"plain word{j * 31 % 97} of text{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(300)]
    rows.append((999, " ".join(f"junk{j}###&&&" for j in range(200)), "en", "s", 1))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(frame(spark, rows, tmp_path)).collect()}
    assert not got.pop(999) and all(got.values())


def test_secret_threshold_keeps_recall():
    import numpy as np

    scores, y = np.array([0.1, 0.5, 0.9, 0.95, 0.99, 0.2]), np.array([0, 1, 1, 1, 1, 0])
    assert secrets.threshold_for(scores, y, 0.75) == 0.9


def test_pii_terms_are_spans_beside_their_entity(spark, tmp_path):
    rows = [(i, f"Herr Quibberton wrote from q@quibber.org again number {i}", "en", "s", 1) for i in range(6)] + [(100 + i, "Nothing personal is in here at all", "en", "s", 1) for i in range(30)]
    docs = frame(spark, rows, tmp_path)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.findings(docs).collect()}
    assert ("term", 5, 15) in got[0] and all(not v for k, v in got.items() if k >= 100)
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "[email]" in text[0] and "Quibberton" not in text[0] and text[100] == rows[6][1]


def test_windows():
    assert windows_of(b"abc", 5).tobytes() == b"abc  " and windows_of(b"abcdefg", 5).tobytes() == b"abcde" + b"cdefg"


def test_pipeline(spark, odd_dir, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "mixture"]
    got = corpus_pipeline.run(spark, odd_dir)
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) < {d["doc_id"] for d in documents}
    assert sorted(r[0] for r in got.select("mix_position").collect()) == list(range(len(ids)))
    leaks = {d["doc_id"] for d in documents if d["source"] == "leak"}
    assert not leaks & set(ids)
    assert set(got.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_clashing_columns(spark, tmp_path):
    rows = [(i, "some plain english words are here " * 3, "en", "s", 1) for i in range(20)]
    docs = frame(spark, rows, tmp_path).withColumns({c: F.lit("x") for c in ("__n", "mix_slot", "h", "kept", "fp", "block")})
    assert mixing.mix(docs).count() == 20
    assert simhash.keep_one(docs).count() == 1
    assert set(linededup.dedup(docs).columns) == set(docs.columns)
