"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put into a hashed order and cut into blocks of equal
size. Weights are whole numbers that make up one period of slots. Source s with
weight w of P has to get w of every P slots: its block j may start at slot
floor(j*P/w) and has to end by ceil((j+1)*P/w). The earliest deadline first rule
over these windows gives each slot one block, and after any number of slots
every source is less than one block away from its share. At a period's end all
are even, so one period is the schedule: it repeats until a source is used up,
and from that slot on the others share the weight in proportion. Every row gets
exactly one place.

The driver walks over one period for each source that is used up, whatever the
number of rows: at most ``MAX_SOURCES`` times ``PERIOD`` (or 16 slots for each
source). Rows are ranked without any per-source sort: a source's hash range is
cut into bins of about ``BIN_ROWS`` rows, offsets come from the bins' counts,
and only rows of one bin are sorted together. The hash is of the id and the
row's number in its file, so rows without an id and repeated rows spread like
any others.

Nulls: a null source is a source of its own. Repeated rows get places of their
own. An empty table gives an empty result. Columns of the input that are called
like the added ones are replaced; any other names may occur. More than
``MAX_SOURCES`` sources are an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import SMALL, bounded, fresh, located, quoted, stored, table

BLOCK_ROWS, PERIOD, MAX_SOURCES, BIN_ROWS, ALPHA = 64, 20_000, 1000, 2_000, 0.5
ADDED = ("mix_slot", "mix_block", "mix_position")


def period(weights: dict[int, int], most: int | None = None) -> list[int]:
    """The source of each slot of one period, or of its first ``most``: earliest deadline first over the blocks' windows."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    order = []
    for t in range(total if most is None else min(total, most)):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        order.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return order


@dataclass
class Phase:
    """Slots during which the same sources take part."""

    first: int  # slot
    slots: int
    weights: dict[int, int]
    order: list[int]  # of one period
    given: dict[int, int]  # blocks before this phase


def phases(weights: list[int], blocks: list[int]) -> list[Phase]:
    """``weights`` are positive integers, ``blocks`` how many each source has."""
    given, found, first = [0] * len(blocks), [], 0
    while left := {s: n - given[s] for s, n in enumerate(blocks) if n > given[s]}:
        own = {s: weights[s] for s in left}
        total = sum(own.values())
        whole = min((n - 1) // own[s] for s, n in left.items())  # periods in which nobody is used up
        rest = {s: n - whole * own[s] for s, n in left.items()}
        order, seen, at = period(own, max(1, sum(left.values()))), dict.fromkeys(left, 0), 0
        while all(rest.values()):
            s = order[at]
            rest[s] -= 1
            seen[s] += 1
            at += 1
        found.append(Phase(first, whole * total + at, own, order, {s: given[s] for s in left}))
        for s in left:
            given[s] += whole * own[s] + seen[s]
        first += whole * total + at
    return found


def schedule(weights: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """(source, block) for each slot, written out."""
    slots = []
    for p in phases(weights, blocks):
        at = dict(p.given)
        for t in range(p.slots):
            s = p.order[t % len(p.order)]
            slots.append((s, at[s]))
            at[s] += 1
    return slots


def whole_weights(weights: list[float], total: int | None = None) -> list[int]:
    """Weights as positive integers that sum up to ``total`` slots, the largest remainders rounded up."""
    total = total or max(PERIOD, 16 * len(weights))
    whole = sum(weights) or 1.0
    exact = [max(0.0, w) / whole * total for w in weights]
    out = [max(1, int(x)) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: int(exact[i]) - exact[i])[: max(0, total - sum(out))]:
        out[i] += 1
    return out


def plan_of(spark: SparkSession, names: list[str], sizes: list[int], weights: list[int], block_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(k, spans): the phases of each source; (k, phase, i, at): the places of its blocks in a period; and how many of the latter."""
    spans: dict[int, list[tuple]] = {s: [] for s in range(len(names))}
    at_rows, first_row = [], 0
    for n, p in enumerate(phases(weights, [-(-x // block_rows) for x in sizes])):
        for s, w in p.weights.items():
            spans[s].append((p.given[s], n, w, len(p.order), p.first, first_row))
        seen = dict.fromkeys(p.weights, 0)
        for at, s in enumerate(p.order[: p.slots]):
            at_rows.append((names[s], n, seen[s], at))
            seen[s] += 1
        used_up = next(s for s in [p.order[(p.slots - 1) % len(p.order)]])
        first_row += p.slots * block_rows - (-sizes[used_up] % block_rows)
    kinds = "k string, spans array<struct<start:bigint,phase:int,w:bigint,period:bigint,slot:bigint,row:bigint>>"
    kind = pa.schema([("k", pa.string()), ("phase", pa.int32()), ("i", pa.int64()), ("at", pa.int64())])
    columns = zip(*at_rows, strict=True) if at_rows else [()] * 4
    places = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind))
    return spark.createDataFrame([(names[s], x) for s, x in spans.items()], kinds), places, len(at_rows)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA, seed: int = 3) -> DataFrame:
    """``docs`` with mix_slot, mix_block and mix_position (0-based, without gaps).

    Without ``weights`` the target weight of a source is its row count to the
    power ``alpha``. Sources missing in ``weights`` get the least weight there.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    f, r = (fresh(docs.columns, n) for n in ("_f", "_r"))
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    counts = docs.groupBy(key.alias("k")).count().orderBy("k").limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not counts:
        return docs.withColumns({n: F.lit(None).cast("bigint") for n in ADDED})
    names, sizes = [c["k"] for c in counts], [c["count"] for c in counts]
    if weights is None:
        target = [n**alpha for n in sizes]
    else:
        given = {"0" if s is None else f"1{s}": w for s, w in weights.items()}
        target = [given.get(n, min(given.values(), default=1.0)) for n in names]
    spans, places, n_places = plan_of(spark, names, sizes, whole_weights(target), block_rows)
    bins = spark.createDataFrame([(n, max(1, -(-s // BIN_ROWS))) for n, s in zip(names, sizes, strict=True)], "k string, bins bigint")
    whole = located(docs, *docs.columns, marks=(f, r))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.col(r), F.lit(seed)), 11)
    rows = whole.select(F.struct(*quoted(docs.columns)).alias("row"), key.alias("k"), draw.alias("h"), F.col(f).alias("f"), F.col(r).alias("r"))
    rows = rows.join(F.broadcast(bins.join(spans, "k")), "k").withColumn("bin", F.floor(F.col("h") / float(1 << 53) * F.col("bins")).cast("bigint"))
    tally = stored(rows.groupBy("k", "bin").count(), "mix-tally")
    before = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(tally.select("k", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "mix-offset")
    inside = Window.partitionBy("k", "bin").orderBy("h", "r", "f")
    rank = F.col("before") + F.row_number().over(inside) - 1
    ranked = rows.join(bounded(offsets), ["k", "bin"]).withColumn("rank", rank).withColumn("mix_block", F.floor(F.col("rank") / block_rows).cast("bigint"))
    span = F.element_at(F.filter("spans", lambda x: x["start"] <= F.col("mix_block")), -1)
    ranked = ranked.withColumn("span", span).withColumns({"phase": F.col("span.phase"), "turn": F.col("mix_block") - F.col("span.start")})
    ranked = ranked.withColumn("i", F.col("turn") % F.col("span.w"))
    done = ranked.join(F.broadcast(places) if n_places <= SMALL else places, ["k", "phase", "i"])
    later = F.floor(F.col("turn") / F.col("span.w")).cast("bigint") * F.col("span.period") + F.col("at")
    return done.select("row.*", (F.col("span.slot") + later).alias("mix_slot"), "mix_block", (F.col("span.row") + later * block_rows + F.col("rank") % block_rows).cast("bigint").alias("mix_position"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
