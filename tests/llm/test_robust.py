"""All operators on tables with clashing columns, repeated rows, nulls and very long texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import ctw, decontam, langid, linededup, mixing, pii, quality, secrets, simhash, warc

CLASHING = ("_f", "_r", "_gone", "_metadata", "_join", "f", "r", "n", "h", "k", "fp", "key", "row", "rank", "block", "gone", "mix_slot", "lang_pred", "lang_score", "kept", "spans", "findings", "payload", "leader", "a", "b")
BENCHMARK = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(330_000))  # over two million characters
    rows = [(1, long, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, "mail a.b@example.org now", "de", "t"), (4, "mail a.b@example.org now", "de", "t"), (None, "some plain words here", "en", None), (5, "x" * 1_000_000, "en", "s"), (6, "line of text number one\n" * 40_000, "en", "s")]
    rows += [(10 + i, " ".join(word() for _ in range(40)), "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


OPERATORS = {
    "simhash classes": (lambda d, b: simhash.classes(d), 68),
    "simhash keep_one": (lambda d, b: simhash.keep_one(d), None),
    "secrets": (lambda d, b: secrets.scan(d, secrets.train(d)), 68),
    "mixing": (lambda d, b: mixing.mix(d), 68),
    "quality": (lambda d, b: quality.judged(d), 68),
    "ctw": (lambda d, b: ctw.score(d), 68),
    "pii": (lambda d, b: pii.findings(d), 68),
    "sanitised": (lambda d, b: pii.sanitised(d), 68),
    "line dedup": (lambda d, b: linededup.dedup(d), 68),
    "langid": (lambda d, b: langid.identify(d, langid.train(d)), 68),
    "langid keep": (lambda d, b: langid.keep_known(d, 0.0), None),
    "decontam": (lambda d, b: decontam.contaminated(d, b), 0),
    "decontam clean": (lambda d, b: decontam.clean(d, b), 68),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, docs, name):
    run, rows = OPERATORS[name]
    got = run(docs, spark.createDataFrame(BENCHMARK, "item_id bigint, text string"))
    if name in ("simhash keep_one", "mixing", "line dedup", "langid", "langid keep", "decontam clean"):
        own = [c for c in docs.columns if not (name == "mixing" and c == "mix_slot" or name == "langid" and c in ("lang_pred", "lang_score"))]
        assert set(docs.columns) <= set(got.columns)
        kept = [r.asDict() for r in got.select(own).collect()]
        assert all(r[c] == f"own {c}" for r in kept for c in CLASHING if c in own)
        n = len(kept)
    else:
        n = got.count()
    assert n == rows if rows is not None else 0 < n < 68


def test_warc_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "p" * 3_000_000), (2, None, None), (2, None, None), (None, "v", "q")], "page_id bigint, url string, html string")
    pages = pages.withColumns({c: F.lit("own") for c in ("payload", "leader", "n", "payload_digest", "refers_to", "path", "bytes")})
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "record_type").collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in got) == [(0, 1, "response"), (1, 3_000_000, "response"), (2, 0, "response"), (2, 0, "response")]
