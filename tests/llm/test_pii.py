"""Surroundings of personal data."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import regex

from sluice.llm import pii


def test_context_goes_over_other_matches(spark, tmp_path):
    card = "Maria Quibberton, born 1980, card 4111 1111 1111 1111 exp 12/27, Springfield"
    texts = [card, "10.0.0.1 10.0.0.2, Ärger😀 " + "1.2.3.4 " * 30 + "tail", "11 " * 60 + card + " 22" * 60, "a@b.co b@c.co"]
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    rows = pii.matches(spark.read.parquet(path)).where("entity IS NOT NULL").collect()
    assert {r["kind"] for r in rows} == {"card", "ip", "email"} and len(rows) == 36
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["before"] == text[max(0, r["start"] - pii.CONTEXT) : r["start"]]
        assert r["behind"] == text[r["end"] : r["end"] + pii.CONTEXT]


def plain_terms(documents, base):
    """Spans of disclosing terms for each document; ``base`` are its valid matches (kind, start, end)."""
    term, edge = regex.compile(r"\p{L}{3,}"), (regex.compile(r"^\p{L}+"), regex.compile(r"\p{L}+$"))
    beside, both, entities, words, total = [], defaultdict(set), Counter(), Counter(), 0
    for k, d in enumerate(documents):
        text = d["text"]
        if text is None:
            continue
        total += text.count(" ") + 1
        words.update(term.findall(text.lower()))
        for kind, start, end in base[k]:
            match = text[start:end]
            entity = kind + ":" + (regex.sub("[^0-9]", "", match) if kind in ("card", "phone") else match.lower())
            entities[entity] += 1
            before, behind = text[max(0, start - pii.CONTEXT) : start], text[end : end + pii.CONTEXT]
            before = edge[0].sub("", before) if len(before) == pii.CONTEXT else before
            behind = edge[1].sub("", behind) if len(behind) == pii.CONTEXT else behind
            for part, origin in ((before, start - len(before)), (behind, end)):
                for m in term.finditer(part):
                    both[entity, m[0].lower()].add((k, start))
                    beside.append((k, entity, m[0].lower(), origin + m.start(), origin + m.end()))
    told = set()
    for (entity, word), at in both.items():
        content = math.log2(total / entities[entity])
        share = min(1.0, len(at) / max(words[word], len(at)))
        if len(at) >= pii.SUPPORT and words[word] and content > 0 and 1 + math.log2(share) / content >= pii.GENERALISE:
            told.add((entity, word))
    spans = defaultdict(set)
    for k, entity, word, start, end in beside:
        if (entity, word) in told:
            spans[k].add((start, end))
    return spans


def test_terms_against_brute_force(spark, documents):
    rng = random.Random(5)
    common = [w for d in documents[:40] for w in (d["text"] or "").split() if w.isalpha()]
    said = lambda n: " ".join(rng.choices(common, k=n))
    docs = [d["text"] for d in documents]
    for i in range(6):
        docs.append(f"{said(30)} Maria Quibberton, mail Maria.Q@example.org or maria.q@example.org, Springfield {said(12)} Quibberton {said(30)}")
        docs.append(f"{said(20)} card 4111 1111 1111 1111 {said(3)} zyxwvu {said(40)} host 10.1.2.3 {said(5)} {'zyxwvu' if i % 2 else 'abcxyz'}")
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(docs)]
    found = pii.findings(spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string"))
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in found.collect()}
    want = plain_terms(docs, [[s for s in rows[d["doc_id"]] if s[0] != "term"] for d in docs])
    got = [{s[1:] for s in rows[d["doc_id"]] if s[0] == "term"} for d in docs]
    assert got == [want[k] for k in range(len(docs))] and sum(map(len, got)) > 10
