"""Parsers: payloads to events and errors.

Input: (source_id, payload, ...). A parser returns ``Parsed``: events, and the
payloads or lines that could not be read, as (source_id, payload, line,
error). Good records of a payload are delivered beside its errors. Every other
column of the input is kept with the events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import regexes
from sluice.functions.times import parse_syslog_time, parse_time_text
from sluice.operators.normalize import events_of, settled
from sluice.schema import FACILITIES

RECORD = "map<string,variant>"


@dataclass
class Parsed:
    events: DataFrame
    errors: DataFrame


@dataclass
class Options:
    delimiter: str = ","
    header: bool = True
    columns: list[str] = field(default_factory=list)
    pattern: str = ""


def _errors(df: DataFrame, line: Column, message: Column) -> DataFrame:
    return df.select("source_id", "payload", line.cast("bigint").alias("line"), message.alias("error"))


def _none(df: DataFrame) -> DataFrame:
    return _errors(df, F.lit(0), F.lit("")).limit(0)


def _trimmed(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("_text", F.trim(F.col("payload"), F.lit(" \t\r\n\f\v")))


def _lines(df: DataFrame) -> DataFrame:
    """One row for each line that is not blank: _line, _at (1-based)."""
    split = df.select("*", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line")).withColumn("_at", F.col("_at") + 1)
    return split.withColumn("_line", F.regexp_replace("_line", "\r$", "")).where(F.trim(F.col("_line"), F.lit(" \t\r\f\v")) != "")


def _object(text: Column) -> Column:
    """Record of a JSON object; null if it is none. A JSON null is an empty record; of repeated keys the last counts."""
    strict = F.when(text.endswith("}"), F.try_variant_get(F.try_parse_json(text), "$", RECORD))
    repeated = F.when(text.startswith("{") & text.endswith("}") & ~text.rlike(r"\}\s*[^\s,\]}]"), F.from_json(text, RECORD, {"mode": "PERMISSIVE"}))
    return F.when(text == "null", F.create_map().cast(RECORD)).otherwise(F.coalesce(strict, repeated))


def json(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """An array of objects (all or nothing), one object, or one object a line. A payload that is a single object may span lines."""
    rows = _trimmed(df).where("_text <> ''")
    rest = [c for c in df.columns if c != "payload"]
    none = F.lit(None).cast(RECORD)
    entry = lambda at, record: F.struct(at.cast("bigint").alias("at"), record.alias("record"))
    is_list, many = F.col("_text").startswith("["), F.contains(F.col("_text"), F.lit("\n"))
    # one strict reading of the payload: a list, or one object that may span lines
    opened = many & F.col("_text").startswith("{") & F.col("_text").endswith("}") & F.try_parse_json(F.substring_index("_text", "\n", 1)).isNull()
    rows = rows.withColumn("_whole", F.when((is_list & F.col("_text").endswith("]")) | opened, F.try_parse_json("_text")))
    records = lambda items: F.transform(items, lambda x: F.when(F.is_variant_null(x), F.create_map().cast(RECORD)).otherwise(F.try_variant_get(x, "$", RECORD)))
    rows = rows.withColumn("_items", records(F.try_variant_get("_whole", "$", "array<variant>")))
    bad = F.col("_items").isNull() | F.exists("_items", lambda r: r.isNull())
    listed = F.when(bad, F.array(entry(F.lit(0), none))).otherwise(F.transform("_items", lambda r: entry(F.lit(0), r)))
    lines = F.transform(F.split("_text", "\n", -1), lambda s, i: F.struct((i + 1).alias("at"), F.trim(s, F.lit(" \t\r\f\v")).alias("s")))
    lines = F.transform(F.filter(lines, lambda x: x["s"] != ""), lambda x: entry(x["at"], _object(x["s"])))
    found = F.when(is_list, listed).when(F.col("_whole").isNotNull(), F.array(entry(F.lit(1), F.try_variant_get("_whole", "$", RECORD)))).otherwise(lines)
    out = rows.select("*", F.explode(found).alias("_x")).select("*", F.col("_x.at").alias("_at"), F.col("_x.record").alias("record"))
    good = out.where(F.col("record").isNotNull()).select(*rest, "record")
    return Parsed(events_of(good, now), _errors(out.where(F.col("record").isNull()), F.col("_at"), F.lit("not a JSON object")))


def csv(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """Delimited rows with a header or given columns; quoted cells may hold line breaks. Extra cells are dropped, missing ones absent."""
    o = options or Options()
    if not o.header and not o.columns:
        raise ValueError("csv without a header needs columns")
    if len(o.delimiter) != 1:
        raise ValueError("csv delimiter has to be one character")
    rest = [c for c in df.columns if c != "payload"]

    def cells(text: str) -> tuple[list[dict[str, str]], str | None]:
        import csv as reader
        import io

        try:
            rows = [r for r in reader.reader(io.StringIO(text, newline=""), delimiter=o.delimiter, strict=True) if r]
        except reader.Error as e:
            return [], str(e)
        names = [c.strip() for c in rows.pop(0)] if o.header and rows else o.columns
        return [{n: v for n, v in zip(names, r, strict=False) if n} for r in rows], None  # the last of equal names counts

    @F.pandas_udf("struct<rows:array<map<string,string>>,error:string>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            for part in slices(batch):
                got = [cells(t) for t in part]
                yield pd.DataFrame({"rows": [rows for rows, _ in got], "error": pd.Series([e for _, e in got], dtype=object)})

    rows = _trimmed(df).where("_text <> ''").withColumn("_csv", read("_text"))
    good = rows.select(*rest, F.explode("_csv.rows").alias("_row")).withColumn("record", F.transform_values("_row", lambda _, v: v.cast("variant")))
    return Parsed(events_of(good.drop("_row"), now), _errors(rows.where("_csv.error IS NOT NULL"), F.lit(0), F.col("_csv.error")))


def slices(texts: pd.Series, rows: int = 256, size: int = 1 << 20) -> Iterator[pd.Series]:
    """``texts`` in slices of ``rows`` and about ``size`` characters at most, unless one text has more: what is made of a slice is in memory together."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= rows or held + len(t) > size):
            yield texts.iloc[at:i]
            at, held = i, 0
        held += len(t)
    yield texts.iloc[at:]


def _last_wins(pairs: str) -> Column:
    """Map of (k, v) structs in which the last of equal keys counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(F.col(pairs), lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, lambda k: last(k).cast("variant")))


KEY_VALUE = r"([A-Za-z_][A-Za-z0-9_.\-]*)=(?:\"([^\"]+)\"|'([^']+)'|([^\t\n\f\r ]+))"


def kv(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """``name=value`` pairs of each line, values bare or quoted; an empty quoted value reads as its two quotes. Lines without a pair are skipped."""
    rest = [c for c in df.columns if c != "payload"]
    rows = _lines(_trimmed(df))
    part = lambda i: F.regexp_extract_all(F.col("_line"), F.lit(KEY_VALUE), F.lit(i))
    pairs = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c")), lambda x: F.struct(x["k"].alias("k"), F.concat(x["a"], x["b"], x["c"]).alias("v")))
    good = rows.withColumn("_pairs", pairs).where(F.size("_pairs") > 0).select(*rest, _last_wins("_pairs").alias("record"))
    return Parsed(events_of(good, now), _none(_trimmed(df)))


def regex(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """Named groups of a pattern, for each line that matches; other lines are skipped."""
    o = options or Options()
    names = regexes.group_names(o.pattern)
    if not names:
        raise ValueError("regex parser needs a pattern with named groups")
    rest = [c for c in df.columns if c != "payload"]
    java = regexes.to_java(o.pattern)
    rows = _lines(_trimmed(df)).where(F.col("_line").rlike(java))
    record = F.create_map(*(x for n, i in names.items() for x in (F.lit(n), F.regexp_extract("_line", java, i).cast("variant"))))
    return Parsed(events_of(rows.select(*rest, record.alias("record")), now), _none(_trimmed(df)))


def raw(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """Every line that is not blank, as it is, as the message."""
    rest = [c for c in df.columns if c != "payload"]
    rows = _lines(df.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("_text", F.col("payload")))
    good = rows.select(*rest, F.create_map(F.lit("message"), F.col("_line").cast("variant")).alias("record"))
    return Parsed(events_of(good, now), _none(_trimmed(df)))


# version, then five fields of which the last holds MSGID, structured data and message
RFC5424 = r"(?s)^[1-9] ([^ ]*)(?: ([^ ]*))?(?: ([^ ]*))?(?: ([^ ]*))?(?: (.*))?$"
BRACKETS = r"\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+\])*+\]"
TAIL = rf"(?s)^ *([^ ]*)(?: +((?:{BRACKETS})+|-)? *(.*))?$"
RFC3164 = r"(?s)^([A-Za-z]{3} +\d{1,2} \d\d:\d\d:\d\d(?:\.\d{1,6})?) +(.*)$"
TAG = r"(?s)^([^\s:\[\]]{1,64})(?:\[([^\]]*)\])?: ?(.*)$"


def syslog(df: DataFrame, now: Column, options: Options | None = None) -> Parsed:
    """Syslog lines: priority, then RFC 5424 or RFC 3164, or a bare message.

    Where the old format's time can't be read the whole rest is the message.
    Structured data may nest four brackets deep and hold several elements.
    """
    rest = [c for c in df.columns if c not in ("payload", "source_id")]
    rows = _lines(_trimmed(df)).withColumn("_line", F.trim(F.col("_line"), F.lit(" \t\r\f\v")))
    pri = F.regexp_extract("_line", r"^<(\d{1,3})>", 1).try_cast("int")
    rows = rows.withColumn("_pri", F.when(pri <= 191, pri))
    rows = rows.withColumn("_rest", F.when(F.col("_pri").isNotNull(), F.regexp_replace("_line", r"^<\d{1,3}>", "")).otherwise(F.col("_line")))
    new = F.col("_rest").rlike(r"^[1-9] ")
    g = lambda p, i, c="_rest": F.regexp_extract(c, p, i)
    dash = lambda c: F.when((c != "-") & (c != ""), c)
    rows = rows.withColumns({"_new": new, "_tail": F.when(new, g(RFC5424, 5)).otherwise(F.lit("")), "_time": g(RFC3164, 1)})
    rows = rows.withColumn("_timed", ~F.col("_new") & parse_syslog_time(F.col("_time"), now).isNotNull())
    rows = rows.withColumn("_after", F.when(F.col("_timed"), g(RFC3164, 2)).otherwise(F.col("_rest")))
    rows = rows.withColumns({"_host": F.regexp_extract("_after", r"^([^ ]+) +", 1), "_body": F.when(F.col("_timed"), F.regexp_replace("_after", r"^[^ ]+ +", "")).otherwise(F.col("_after"))})
    tag, proc, said = (g(TAG, i, "_body") for i in (1, 2, 3))
    tagged = F.col("_timed") & F.col("_body").rlike(TAG)
    facility = F.floor(F.col("_pri") / 8).cast("int")
    names = F.create_map(*(F.lit(x) for pair in FACILITIES.items() for x in pair))
    fields = {
        "facility": facility.cast("string"),
        "facility_name": F.try_element_at(names, facility),
        "procid": F.when(F.col("_new"), dash(g(RFC5424, 4))).when(tagged, dash(proc)),
        "msgid": F.when(F.col("_new"), dash(g(TAIL, 1, "_tail"))),
        "structured_data": F.when(F.col("_new"), dash(g(TAIL, 2, "_tail"))),
        "message": F.when(F.col("_new"), dash(g(TAIL, 3, "_tail"))).when(tagged, said).otherwise(F.col("_body")),
    }
    attrs = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("variant")))), lambda _, v: v.isNotNull())
    severity = F.when(F.col("_pri").isNotNull(), F.lit(8) - F.col("_pri") % 8).otherwise(F.lit(2))
    events = rows.select(
        F.lit("").alias("id"),
        F.when(F.col("_new"), parse_time_text(dash(g(RFC5424, 1)))).when(F.col("_timed"), parse_syslog_time(F.col("_time"), now)).alias("timestamp"),
        "source_id",
        F.coalesce(F.when(F.col("_new"), dash(g(RFC5424, 2))).when(F.col("_timed"), F.col("_host")), F.lit("")).alias("host"),
        severity.alias("severity"),
        F.coalesce(F.when(F.col("_new"), dash(g(RFC5424, 3))).when(tagged, tag), F.lit("")).alias("category"),
        *(F.lit("").alias(c) for c in ("actor", "resource", "trace_id")),
        attrs.alias("attrs"),
        F.array().cast("array<string>").alias("tags"),
        now.alias("received_at"),
        *rest,
    )
    return Parsed(settled(events, now), _none(_trimmed(df)))


PARSERS: dict[str, Callable[..., Parsed]] = {"json": json, "ndjson": json, "csv": csv, "kv": kv, "regex": regex, "syslog": syslog, "raw": raw}


def register(name: str, parser: Callable) -> None:
    """Offer a further parser (payloads, now, options) -> Parsed; sources may name it from then on."""
    if name in PARSERS:
        raise ValueError(f"parser {name!r} is taken")
    PARSERS[name] = parser


def parse(df: DataFrame, name: str, now: Column, options: Options | None = None) -> Parsed:
    """Parse with a registered parser; a blank name means json."""
    if (name or "json") not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[name or "json"](df, now, options)
