"""The canonical event view of the driver's events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.schema import EVENT_COLUMNS

LEVELS = {"click": 2, "view": 1, "signup": 3, "purchase": 4, "error": 5}
KEY = "ya29"


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def message() -> F.Column:
    """A log text with personal data in part of the rows."""
    n = F.col("event_id")
    extra = F.when(n % 10 == 0, F.concat(F.lit(" mail u"), F.col("user_id"), F.lit("@example.com"))).when(n % 10 == 1, F.concat(F.lit(" card 4111 1111 1111 "), F.lpad((n % 10000).cast("string"), 4, "0"))).when(n % 10 == 2, F.concat(F.lit(" Authorization: Bearer tok"), F.lpad(n.cast("string"), 8, "0"))).when(n % 10 == 3, F.concat(F.lit(" key AKIA"), F.lpad(n.cast("string"), 16, "0"))).otherwise("")
    return F.concat(F.col("event_type"), F.lit(" by user-"), F.col("user_id"), extra)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in canonical form. They are dealt to all cores first: a file of many millions of rows may be no more than one split."""
    return canonical(raw(spark, sf_dir).repartition("event_id"))


def canonical(rows: DataFrame) -> DataFrame:
    """Rows of the events table in canonical form."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    level = F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p))
    attrs = F.create_map(F.lit("value"), F.col("value").cast("variant"), F.lit("k"), k.cast("variant"), F.lit("message"), message().cast("variant"), F.lit("props"), F.parse_json("props"))
    attrs = F.when(F.col("event_id") % 4 == 0, F.map_concat(attrs, F.create_map(F.lit("secret"), F.concat(F.lit("s-"), F.col("event_id")).cast("variant")))).otherwise(attrs)
    tags = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("third"))).otherwise(F.array().cast("array<string>"))
    text = lambda *parts: F.concat(*parts)
    return rows.select(
        text(F.lit("evt-"), "event_id").alias("id"), F.col("ts").alias("timestamp"), F.lit("events").alias("source_id"), text(F.lit("edge-"), F.col("user_id") % 6).alias("host"), F.element_at(level, F.col("event_type")).alias("severity"),
        F.col("event_type").alias("category"), text(F.lit("user-"), "user_id").alias("actor"), F.when(F.col("event_id") % 5 == 0, "").otherwise(text(F.lit("/item/"), F.col("event_id") % 50)).alias("resource"), F.lit("").alias("trace_id"),
        attrs.alias("attrs"), tags.alias("tags"), F.col("ts").alias("received_at"),
    ).select(*EVENT_COLUMNS)


EV = """
WITH ev AS (
  SELECT 'evt-' || event_id AS id, event_id, ts, user_id, event_type AS category, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         'edge-' || (user_id % 6) AS host, 'user-' || user_id AS actor,
         CASE WHEN event_id % 5 = 0 THEN '' ELSE '/item/' || (event_id % 50) END AS resource,
         CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS severity,
         event_type || ' by user-' || user_id || CASE event_id % 10
           WHEN 0 THEN ' mail u' || user_id || '@example.com'
           WHEN 1 THEN ' card 4111 1111 1111 ' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
           WHEN 2 THEN ' Authorization: Bearer tok' || lpad(CAST(event_id AS VARCHAR), 8, '0')
           WHEN 3 THEN ' key AKIA' || lpad(CAST(event_id AS VARCHAR), 16, '0') ELSE '' END AS message,
         CASE WHEN event_id % 4 = 0 THEN 's-' || event_id END AS secret, event_id % 3 = 0 AS third
  FROM events
)
"""
