"""Synthetic events for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("auth", "network", "process", "file", "health-check", "api", "audit")
#: Severities with the percentage up to which each is drawn.
LEVELS = (("info", 62), ("debug", 80), ("warning", 91), ("error", 97), ("alert", 99), ("emergency", 100))


def payloads(spark: SparkSession, n: int, source_id: str = "gen", seed: int = 1, per_payload: int = 1000) -> DataFrame:
    """(seq, source_id, payload, received_us): NDJSON payloads with ``n`` events in all."""
    roll = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed * 1000 + k)), F.lit(m)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), roll(k, len(xs)) + 1)
    level = F.coalesce(*(F.when(roll(2, 100) < top, name) for name, top in LEVELS))
    rows = spark.range(n)
    event = F.to_json(
        F.struct(
            F.concat(F.lit(f"gen-{seed}-"), "id").alias("id"), F.lit(source_id).alias("source"), F.concat(F.lit("host-"), roll(1, 64)).alias("host"), level.alias("severity"), pick(3, CATEGORIES).alias("category"),
            F.concat(F.lit("user-"), roll(4, 500)).alias("actor"), F.concat(F.lit("/api/v1/item/"), roll(5, 1000)).alias("resource"), F.sha1(F.col("id").cast("string")).alias("trace_id"),
            F.concat(F.lit("request "), "id", F.lit(" served")).alias("message"), F.concat(F.lit("person"), roll(6, 500), F.lit("@example.com")).alias("contact_email"),
            (roll(7, 100_000) / 100).alias("latency_ms"), F.struct(F.concat(F.lit("zone-"), roll(8, 4)).alias("zone"), roll(9, 600).alias("status")).alias("attributes"),
        )
    )
    lines = rows.select(F.floor(F.col("id") / per_payload).alias("seq"), event.alias("e"))
    return lines.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("e")), "\n").alias("payload")).select("seq", F.lit(source_id).alias("source_id"), "payload", F.lit(1_700_000_000_000_000).cast("bigint").alias("received_us"))
