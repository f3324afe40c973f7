"""The verdict of the quality rules against exact quantiles."""

from __future__ import annotations

import numpy as np

from sluice.llm import quality
from sluice.llm.catalogue import QUERIES


def ratios(d):
    m = dict(zip((*quality.COUNTS, *quality.EXTRA), quality.measure(d["text"]), strict=True))
    over = lambda a, b: m[a] / m[b] if m[b] else None
    return m, {"symbols": over("n_symbols", "n_words"), "upper": over("n_upper", "n_letters"), "marks": over("n_marks", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}


def test_verdict_against_exact_quantiles(spark, odd_dir, documents):
    """All groups are small here, so the fences are those of all documents with words; what is right at a fence may fall on either side."""
    measured = [ratios(d) for d in documents]
    fences = {}
    for k, least in quality.LEAST.items():
        values = sorted(r[k] or 0.0 for m, r in measured if m["n_words"])
        q1, q3 = np.quantile(values, [0.25, 0.75], method="inverted_cdf")
        fences[k] = (q1, q3, max(q3 - q1, least))
    got = {}
    for r in QUERIES["op5_quality"](spark, odd_dir).collect():
        got.setdefault(r["doc_id"], set()).add(r["kept"])
    checked = failed = 0
    for d, (m, r) in zip(documents, measured, strict=True):
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        far = [0.0]
        for k, (q1, q3, width) in fences.items():
            if r[k] is not None:
                far.append((r[k] - q3) / width - quality.REACH)
                if k == "word_length":
                    far.append((q1 - r[k]) / width - quality.REACH)
        if base or abs(max(x for x in far)) > 0.1 or max(far) == 0.0:
            want = not base and max(far[1:], default=-1.0) <= 0
            checked += 1
            failed += not base and not want
            assert got[d["doc_id"]] == {want}, (d["doc_id"], far)
    assert checked > 0.9 * len(documents) and failed
