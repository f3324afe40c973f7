"""Deduplication by event id within a time to live.

An event is a duplicate if an event with its id was *accepted* less than
``ttl`` before; a duplicate does not extend the time. Events without an id are
never duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(events: DataFrame, arrival: str, tie: str | None = None) -> DataFrame:
    """The first event of each id (time to live at least the table's span).

    A minimum per id, merged before the shuffle, picks the arrival to keep;
    only ties on it are numbered, so no id's rows are sorted in one task.
    """
    order = [arrival, *([tie] if tie else [])]
    named = events.where(F.coalesce(F.col("id"), F.lit("")) != "")
    first = named.groupBy("id").agg(F.min(F.struct(*order)).alias("_first"))
    kept = named.join(first, "id").where(F.struct(*order) == F.col("_first")).drop("_first")
    if tie is None:
        number = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(*[c for c, t in events.dtypes if "variant" not in t and "map" not in t])))
        kept = kept.withColumn("_n", number).where("_n = 1").drop("_n")
    return kept.select(events.columns).unionByName(events.where(F.coalesce(F.col("id"), F.lit("")) == ""))


def first_of_each(events: DataFrame, key: str, arrival: str, tie: str) -> DataFrame:
    """Of rows with the same key and arrival the one with the least ``tie``; rows without a key all stay."""
    named = F.coalesce(F.col(key), F.lit("")) != ""
    least = events.where(named).groupBy(F.col(key).alias("_k"), F.col(arrival).alias("_a")).agg(F.min(tie).alias("_least"))
    same = (F.col(key) == F.col("_k")) & (F.col(arrival) == F.col("_a")) & (F.col(tie) == F.col("_least"))
    return events.where(named).join(least, same, "left_semi").unionByName(events.where(~named))


def accepted_times(times: Column, ttl: Column) -> Column:
    """Of sorted arrival times those that are accepted: each at least ``ttl`` after the last accepted one."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= ttl), F.struct(t.alias("last"), F.array_append(acc["kept"], t).alias("kept"))).otherwise(acc)
    return F.aggregate(F.sort_array(times), start, step, lambda acc: acc["kept"])


def within_ttl(events: DataFrame, arrival: str, ttl_us: int, before: DataFrame | None = None) -> DataFrame:
    """``events`` (arrival in microseconds) with ``duplicate``, exactly.

    Whether an arrival is accepted depends on the last accepted one. Behind a
    gap of ``ttl_us`` or more the next arrival is accepted whatever was before,
    so an id's distinct arrival times fall into runs that don't depend on one
    another, and only the times of one run are folded together; the events
    themselves are joined back and may be split. ``before`` (id, last) are
    acceptances from earlier, one for each id at most.
    """
    named = F.coalesce(F.col("id"), F.lit("")) != ""
    times = events.where(named).select("id", F.col(arrival).cast("bigint").alias("_t")).distinct().withColumn("_old", F.lit(False))
    if before is not None:
        old = before.join(times.select("id").distinct(), "id", "left_semi").select("id", F.col("last").cast("bigint").alias("_t"), F.lit(True).alias("_old"))
        times = times.unionAll(old).groupBy("id", "_t").agg(F.max("_old").alias("_old"))
    order = Window.partitionBy("id").orderBy("_t")
    begins = F.coalesce(F.col("_t") - F.lag("_t").over(order) >= ttl_us, F.lit(True))
    runs = times.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy("id", "_run").agg(F.collect_list("_t").alias("_t"), F.max(F.when(F.col("_old"), F.col("_t"))).alias("_was"))
    kept = folded.select(F.col("id").alias("_id"), F.explode(accepted_times(F.col("_t"), F.lit(ttl_us))).alias("_kept"), "_was").where(F.col("_was").isNull() | (F.col("_kept") != F.col("_was"))).drop("_was")
    number = F.row_number().over(Window.partitionBy("id", arrival).orderBy(F.lit(1)))
    marked = events.join(kept, (F.col("id") == F.col("_id")) & (F.col(arrival) == F.col("_kept")), "left")
    again = (F.col("_kept").isNull() | (number > 1)) & named
    return marked.withColumn("duplicate", again).drop("_id", "_kept")


def stream_within_watermark(events: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Streaming, by event time: one event of each id within the watermark's delay."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id"])


def stream_exact(events: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """Streaming, by processing time: the first event of each id, again after its time to live.

    With a time to live the query needs an ordinary trigger (state timers keep
    an ``availableNow`` query from ending); without one it ends normally.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import BooleanType, StructField, StructType

    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            schema = StructType([StructField("seen", BooleanType())])
            self.seen = handle.getValueState("seen", schema, ttlDurationMs=ttl) if ttl else handle.getValueState("seen", schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            known, out = self.seen.exists(), None
            for batch in rows:
                if out is None and not known and len(batch):
                    out = batch.head(1)
            if out is not None:
                self.seen.update((True,))
                yield out

        def close(self) -> None:
            pass

    return events.groupBy("id").transformWithStateInPandas(First(), events.schema, "Append", "ProcessingTime" if ttl else "None")
