"""Timestamps in the encodings that producers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.binding import bind

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ISO = r"^\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z|[+-]\d\d:\d\d)?| \d\d:\d\d:\d\d(?:[.,]\d{1,9})?)?$"
#: Mon, 02 Jan 2006 15:04:05 -0700 and 02 Jan 06 15:04 MST
MAIL = r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]{3}) (\d{4}|\d\d) (\d\d:\d\d(?::\d\d)?) ([+-]\d{4}|[A-Z]{1,4})$"
#: Mon Jan _2 15:04:05 2006, with or without a zone before the year
UNIX = r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d\d:\d\d:\d\d)(?: ([+-]\d{4}|[A-Z]{1,4}))? (\d{4})$"
NUMBER = r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?$"
SYSLOG = r"^([A-Za-z]{3}) +(\d{1,2}) (\d\d:\d\d:\d\d(?:\.\d{1,6})?)$"


def epoch_sql(n: str) -> str:
    """SQL timestamp of ``n`` seconds, milli-, micro- or nanoseconds since 1970, told apart by size; null for zero and less."""
    micros = f"(CASE WHEN {n} > 1e17D THEN {n} / 1000 WHEN {n} > 1e14D THEN {n} WHEN {n} > 1e11D THEN {n} * 1000 ELSE {n} * 1e6D END)"
    return f"CASE WHEN {n} > 0 AND {micros} < 9e18D THEN timestamp_micros(cast(floor({micros}) AS bigint)) END"


def from_epoch(n: Column) -> Column:
    return bind(n.cast("double"), epoch_sql("v"))


def _group(pattern: str, i: int) -> str:
    return f"regexp_extract(v, r'{pattern}', {i})"


def _built(year: str, month: str, day: str, clock: str, zone: str) -> str:
    """SQL timestamp of the parts of a date; zones that are no offset count as UTC."""
    names = ", ".join(f"'{m}'" for m in MONTHS)
    number = f"lpad(cast(array_position(array({names}), lower({month})) AS string), 2, '0')"
    offset = rf"if({zone} RLIKE r'^[+-]\d{{4}}$', regexp_replace({zone}, r'(..)$', ':$1'), '+00:00')"
    return f"try_to_timestamp(concat({year}, '-', {number}, '-', lpad({day}, 2, '0'), 'T', {clock}, {offset}))"


def time_sql() -> str:
    """SQL timestamp of the trimmed text ``v``: ISO forms, mail and C library dates, numbers; null if it is none of these."""
    exact = r"regexp_replace(replace(v, ',', '.'), r'(\.\d{6})\d+', '$1')"
    short = _group(MAIL, 3)
    year = f"CASE WHEN length({short}) = 4 THEN {short} WHEN {short} >= '69' THEN concat('19', {short}) ELSE concat('20', {short}) END"
    clock = f"if(length({_group(MAIL, 4)}) = 5, concat({_group(MAIL, 4)}, ':00'), {_group(MAIL, 4)})"
    mail = _built(year, _group(MAIL, 2), _group(MAIL, 1), clock, _group(MAIL, 5))
    unix = _built(_group(UNIX, 5), _group(UNIX, 1), _group(UNIX, 2), _group(UNIX, 3), _group(UNIX, 4))
    return f"CASE WHEN v RLIKE r'{ISO}' THEN try_to_timestamp({exact}) WHEN v RLIKE r'{NUMBER}' THEN {epoch_sql('try_cast(v AS double)')} WHEN v RLIKE r'{MAIL}' THEN {mail} WHEN v RLIKE r'{UNIX}' THEN {unix} END"


def parse_time_text(text: Column) -> Column:
    return bind(F.trim(text), time_sql())


def parse_syslog_time(text: Column, now: Column) -> Column:
    """``Jan _2 15:04:05``: the current year, or the one before if that is more than a day ahead of ``now``."""
    at = lambda year: _built(f"cast({year} AS string)", _group(SYSLOG, 1), _group(SYSLOG, 2), _group(SYSLOG, 3), "'+00:00'")
    this, last = (at(y).replace("(v,", "(v.t,") for y in ("year(v.now)", "year(v.now) - 1"))
    body = f"CASE WHEN v.t RLIKE r'{SYSLOG}' THEN if({this} IS NULL OR {this} > v.now + INTERVAL 1 DAY, {last}, {this}) END"
    return bind(F.struct(text.alias("t"), now.alias("now")), body)
