"""Records to canonical events.

A record is a map of names to VARIANT values. Known names, in a fixed order of
preference, become event columns; everything else stays in attrs. The first
listed name that is present decides, and if its value can't be read the
default applies; names that lose stay in attrs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.binding import bind
from sluice.functions.times import from_epoch, parse_time_text
from sluice.functions.values import variant_kind, variant_text
from sluice.schema import EVENT_COLUMNS, FIELD_ALIASES, SEVERITY_ALIASES, TEXT_COLUMNS


def parse_severity(text: Column) -> Column:
    """Number of a severity name or of 0..8; empty is info; null if unknown."""
    names = " ".join(f"WHEN '{k}' THEN {n}" for k, n in SEVERITY_ALIASES.items())
    return bind(F.lower(F.trim(text)), f"CASE v WHEN '' THEN 2 {names} ELSE if(v RLIKE '^[0-8]$', try_cast(v AS int), NULL) END")


def parse_time(v: Column) -> Column:
    """Timestamp of a VARIANT: text or epoch number."""
    return F.when(variant_kind(v) == "STRING", parse_time_text(F.try_variant_get(v, "$", "string"))).otherwise(from_epoch(F.try_variant_get(v, "$", "double")))


def events_of(df: DataFrame, now: Column, record: str = "record", source: str = "source_id") -> DataFrame:
    """Events of ``df``'s records; its other columns are kept."""
    rest = [c for c in df.columns if c not in (record, source, *EVENT_COLUMNS)]
    live = df.withColumn(record, F.map_filter(F.coalesce(record, F.create_map().cast("map<string,variant>")), lambda _, v: v.isNotNull() & ~F.is_variant_null(v)))
    chosen = {k: F.coalesce(*(F.when(F.map_contains_key(record, n), F.lit(n)) for n in names)) for k, names in FIELD_ALIASES.items()}
    live = live.withColumns({f"_n_{k}": c for k, c in chosen.items()})
    live = live.withColumns({f"_v_{k}": F.try_element_at(F.col(record), F.col(f"_n_{k}")) for k in FIELD_ALIASES})
    value = lambda k: F.col(f"_v_{k}")
    text = lambda k: F.trim(variant_text(value(k)))
    used = F.array(*(F.col(f"_n_{k}") for k in FIELD_ALIASES))
    attrs = F.map_filter(record, lambda k, _: ~F.coalesce(F.array_contains(used, k), F.lit(False)))
    attrs = F.when(F.col("_n_message").isNotNull(), F.map_concat(F.map_filter(attrs, lambda k, _: k != "message"), F.create_map(F.lit("message"), variant_text(value("message")).cast("variant")))).otherwise(attrs)
    columns = {k: F.coalesce(text(k), F.lit("")) for k in ("host", "category", "actor", "resource", "trace_id")}
    out = live.select(
        variant_text(F.try_element_at(F.col(record), F.lit("id"))).alias("id"),
        parse_time(value("timestamp")).alias("timestamp"),
        F.col(source).alias("source_id"),
        columns["host"].alias("host"),
        parse_severity(variant_text(value("severity"))).alias("severity"),
        *(columns[k].alias(k) for k in ("category", "actor", "resource", "trace_id")),
        attrs.alias("attrs"),
        F.array().cast("array<string>").alias("tags"),
        now.alias("received_at"),
        *rest,
    )
    return settled(out, now)


def settled(events: DataFrame, now: Column) -> DataFrame:
    """Defaults and trimming: no timestamp is ``now``, unknown severity is info, texts are trimmed."""
    severity = F.when(F.col("severity").between(1, 8), F.col("severity")).otherwise(F.lit(2))
    trimmed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in TEXT_COLUMNS}
    return events.withColumns(trimmed | {"timestamp": F.coalesce("timestamp", now), "severity": severity.cast("int"), "id": F.coalesce("id", F.lit("")), "attrs": F.coalesce("attrs", F.create_map().cast("map<string,variant>")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def digest() -> Column:
    """Content id: 32 hex digits over everything but id and received_at.

    Keys of attrs are sorted, so the order they arrived in doesn't matter.
    """
    keys = F.array_sort(F.map_keys("attrs"))
    pairs = F.transform(keys, lambda k: F.concat_ws("\x1f", k, F.to_json(F.element_at(F.col("attrs"), k))))
    stamp = F.unix_micros("timestamp").cast("string")
    parts = [stamp, *(F.coalesce(c, F.lit("")) for c in TEXT_COLUMNS), F.col("severity").cast("string"), F.array_join("tags", "\x1f"), F.array_join(pairs, "\x1e")]
    return F.substring(F.sha2(F.concat_ws("\x1d", *parts), 256), 1, 32)


def ensure_id(events: DataFrame) -> DataFrame:
    return events.withColumn("id", F.when(F.coalesce(F.col("id"), F.lit("")) == "", digest()).otherwise(F.col("id")))


def attributed(events: DataFrame, source_id: str, category: str = "", tags: tuple[str, ...] = ()) -> DataFrame:
    """Events as a configured source delivers them: its id, its category if set, its tags appended."""
    new = {"source_id": F.lit(source_id)}
    if category:
        new["category"] = F.lit(category)
    if tags:
        new["tags"] = F.concat("tags", F.array(*map(F.lit, tags)))
    return events.withColumns(new)


def canonical_json() -> Column:
    """An event as one JSON text: empty fields left out, severity by name, times in RFC 3339."""
    from sluice.functions.values import severity_name, time_text

    text = {c: F.when(F.col(c) != "", F.col(c)) for c in ("host", "category", "actor", "resource", "trace_id")}
    fields = [
        F.col("id"), time_text(F.col("timestamp")).alias("timestamp"), F.col("source_id"), text["host"].alias("host"), severity_name(F.col("severity")).alias("severity"),
        *(text[c].alias(c) for c in ("category", "actor", "resource", "trace_id")),
        F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), time_text(F.col("received_at")).alias("received_at"),
    ]
    return F.to_json(F.struct(*fields))
