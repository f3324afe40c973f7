"""Mixing against a plain walk over all slots."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from sluice.llm import mixing


def plain_slots(weights, blocks):
    """Slot by slot: of the blocks whose window has begun the one that has to end first; starts anew when a source is used up."""
    left, given, out = {s: n for s, n in enumerate(blocks) if n}, Counter(), []
    while left:
        total, turn, t, n = sum(weights[s] for s in left), Counter(), 0, len(left)
        while len(left) == n:
            open_ = [(-(-(turn[s] + 1) * total // weights[s]), s) for s in left if turn[s] * total // weights[s] <= t]
            s = min(open_)[1]
            out.append((s, given[s]))
            given[s] += 1
            turn[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
    return out


def test_schedule_against_the_walk():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 6)
        weights, blocks = [rng.randint(1, 9) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        assert mixing.schedule(weights, blocks) == plain_slots(weights, blocks), (weights, blocks)


def test_no_source_is_a_block_off_its_share():
    weights = mixing.whole_weights([0.5, 0.3, 0.15, 0.05], 200)
    assert sum(weights) == 200
    given = Counter()
    for t, s in enumerate(mixing.period(dict(enumerate(weights))), 1):
        given[s] += 1
        assert all(abs(given[x] - Fraction(t * w, 200)) < 1 for x, w in enumerate(weights))


def test_query_against_brute_force(spark, odd_dir, documents):
    """Every row has a place of its own, and its block stands where the plain walk puts it."""
    got = mixing.op4_mixing(spark, odd_dir).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((d["doc_id"], d["source"]) for d in documents)
    assert sorted(r["mix_position"] for r in got) == list(range(len(documents)))
    sizes = Counter(d["source"] for d in documents)
    names = sorted(sizes, key=lambda s: "0" if s is None else f"1{s}")
    weights = mixing.whole_weights([sizes[s] ** mixing.ALPHA for s in names])
    slots = plain_slots(weights, [-(-sizes[s] // mixing.BLOCK_ROWS) for s in names])
    held = defaultdict(list)
    for r in got:
        held[r["mix_slot"]].append(r)
    first = 0
    for t, (s, b) in enumerate(slots):
        rows = held[t]
        assert {(r["source"], r["mix_block"]) for r in rows} == {(names[s], b)}
        assert sorted(r["mix_position"] for r in rows) == list(range(first, first + len(rows)))
        assert len(rows) == min(mixing.BLOCK_ROWS, sizes[names[s]] - b * mixing.BLOCK_ROWS)
        first += len(rows)


def test_many_blocks(spark):
    """Several periods and phases: the places are those of the walk."""
    rows = [(i, "abc"[min(2, i % 7)] if i % 11 else None) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string").repartition(3), {"a": 3, "b": 2, "c": 1}, block_rows=1).collect()
    sizes = Counter(r[1] for r in rows)
    names = [None, "a", "b", "c"]
    slots = plain_slots(mixing.whole_weights([1, 3, 2, 1]), [sizes[s] for s in names])
    assert [names[s] for s, _ in slots] == [r["source"] for r in sorted(got, key=lambda r: r["mix_position"])]


def test_clashing_columns_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 10)
    names = ("k", "first", "offset", "bins", "h", "f", "r", "row", "rank", "phase", "spans", "_f", "_r", "_metadata", "at", "i", "span", "turn", "mix_slot", "a.b c")
    df = spark.range(200).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), *(F.lit("own").alias(n) for n in names))
    got = mixing.mix(df)
    assert set(got.columns) == {*df.columns, *mixing.ADDED}
    rows = got.collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(200))
    assert all(r[n] == "own" for r in rows for n in names if n != "mix_slot")
