"""Decontamination against every window of every text, and paraphrases."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow.parquet as pq

from sluice.llm import decontam

BASE = "/root/testdata/sf0.001"


def plain_hits(docs, items):
    """(doc_id, item_id) by the subsequence test on all windows, without any index."""
    found = set()
    for d in docs:
        words = decontam.words_of(d["text"])
        for k in items:
            item = decontam.words_of(k["text"])
            if not item:
                continue
            bag, width = Counter(item), 2 * len(item) + 2 * decontam.STEP
            for at in range(0, max(1, len(words)), decontam.STEP):
                near = words[max(0, at - len(item)) : at - len(item) + width]
                if len(item) < decontam.SHORT:
                    ok = decontam.contains(near, item)
                else:
                    if sum(bag[w] for w in bag.keys() & set(near)) < decontam.MIN_PART * len(item):
                        continue
                    share = decontam.lcs(item, near) / len(item)
                    ok = share >= decontam.MIN_LCS or share >= decontam.MIN_PART and decontam.contains(near, item[-decontam.ANSWER :])
                if ok:
                    found.add((d["doc_id"], k["item_id"]))
                    break
    return found


def test_query_against_all_windows(spark, odd_dir, documents):
    items = pq.read_table(f"{odd_dir}/benchmark.parquet").to_pylist()
    want = plain_hits(documents, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op10_decontam(spark, odd_dir).select("doc_id", "item_id").collect()}
    assert len(want) >= 4 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want) + 1, (want - got, got - want)


def test_paraphrases(spark):
    """Items of which every sixth word is another, put into texts: found by cosine and subsequence; others stay."""
    rng = random.Random(9)
    docs = [d for d in pq.read_table(f"{BASE}/documents.parquet").to_pylist() if len((d["text"] or "").split()) > 60][:80]
    items = [k for k in pq.read_table(f"{BASE}/benchmark.parquet").to_pylist() if len(k["text"].split()) >= 20][:40]
    vocabulary = sorted({w for d in docs for w in d["text"].split()})
    planted, rows = set(), []
    for n, d in enumerate(docs):
        words = d["text"].split()
        if n < len(items):
            said = [rng.choice(vocabulary) if i % 6 == 5 else w for i, w in enumerate(items[n]["text"].split())]
            at = rng.randrange(len(words))
            words[at:at] = said
            planted.add((n, items[n]["item_id"]))
        rows.append((n, " ".join(words)))
    clean = {n for n, d in enumerate(docs) if n >= len(items)}
    already = plain_hits([{"doc_id": n, "text": d["text"]} for n, d in enumerate(docs)], items)
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k["item_id"], k["text"]) for k in items], "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(got & planted) >= 0.95 * len(planted), planted - got
    assert {g for g in got if g[0] in clean} <= already


def test_remembered_words_are_bounded():
    """However many words a worker meets, it holds few; the columns of those it doesn't hold are the same."""
    ids, words = decontam.TermIds([b"one", b"two"]), [b"w%d" % i for i in range(3 * decontam.KEPT)]
    first = [ids[w] for w in words]
    assert len(ids) == 2 + decontam.KEPT <= 100_000 and [ids[w] for w in words] == first == [decontam.TermIds([b"one", b"two"])[w] for w in words]
