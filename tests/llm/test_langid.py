"""Language identification at its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import langid

BASE = "/root/testdata/sf0.001/documents.parquet"


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.read.parquet(BASE)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    texts = ["½ ² ① 12", "__ 7", "½ a", "中", "", None, "1" * 3_000_000, "word " * 500_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, model).collect()}
    assert [got[i] == "und" for i in range(8)] == [not any(c.isalpha() for c in t or "") for t in texts]


def test_training_does_not_follow_order_ids_or_copies(spark):
    docs = spark.read.parquet(BASE).select("doc_id", "text", "lang")
    other = docs.withColumn("doc_id", F.col("doc_id") * 7 + 1).repartition(5)
    a, b = (langid.train(d, per_lang=10_000) for d in (docs, other.unionAll(other.where("doc_id < 60"))))
    assert a.labels == b.labels and all(np.array_equal(a.net.p[k], b.net.p[k]) for k in a.net.p)


def test_predictions_are_those_of_the_plain_network(spark):
    """Scores against embedding, convolution, maximum and softmax written out."""
    docs = spark.read.parquet(BASE).select("doc_id", "text", "lang").limit(60)
    model = langid.train(docs)
    net, p = model.net, model.net.p
    for r in langid.identify(docs, model).collect():
        if r["lang_pred"] == "und":
            continue
        x = langid.windows_of(r["text"].lower().encode("utf-8", "replace"), model.length)
        e, pooled = p["emb"][x], []
        for w in net.widths:
            cols = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            pooled.append((cols @ p[f"k{w}"] + p[f"c{w}"]).max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ p["out"] + p["bias"]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob = prob / prob.sum(axis=1, keepdims=True) * (langid.IS_LETTER[x].sum(axis=1, keepdims=True) + 1e-6)
        mean = prob.sum(axis=0) / prob.sum()
        assert r["lang_pred"] == model.labels[int(mean.argmax())] and abs(r["lang_score"] - mean.max()) < 1e-3
