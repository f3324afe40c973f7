"""The canonical event.

``severity`` is an integer from 0 (unknown) to 8 (emergency) inside the engine
and its name at the edges. ``attrs`` maps names to VARIANT values.
"""

from __future__ import annotations

EVENT_DDL = (
    "id STRING, timestamp TIMESTAMP, source_id STRING, host STRING, severity INT, category STRING, actor STRING, "
    "resource STRING, trace_id STRING, attrs MAP<STRING, VARIANT>, tags ARRAY<STRING>, received_at TIMESTAMP"
)
EVENT_COLUMNS = ("id", "timestamp", "source_id", "host", "severity", "category", "actor", "resource", "trace_id", "attrs", "tags", "received_at")
TEXT_COLUMNS = ("source_id", "host", "category", "actor", "resource", "trace_id")

# The severity scale, its spellings and the field aliases are part of the event format.
SEVERITIES = ("unknown", "debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")
SEVERITY_ALIASES = {
    "debug": 1, "trace": 1, "verbose": 1,
    "info": 2, "informational": 2, "information": 2,
    "notice": 3,
    "warn": 4, "warning": 4,
    "err": 5, "error": 5,
    "crit": 6, "critical": 6, "fatal": 6,
    "alert": 7,
    "emerg": 8, "emergency": 8, "panic": 8,
}
FIELD_ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "time", "ts", "event_time", "eventtime", "created_at", "date"),
    "severity": ("severity", "level", "loglevel", "log_level", "sev", "status", "priority"),
    "host": ("host", "hostname", "host_name", "source_host", "instance", "node", "machine"),
    "category": ("category", "type", "event_type", "eventtype", "log_type", "kind", "component"),
    "actor": ("actor", "user", "username", "user_id", "userid", "principal", "identity"),
    "resource": ("resource", "path", "url", "uri", "endpoint", "target", "object"),
    "trace_id": ("trace_id", "traceid", "trace", "request_id", "requestid", "correlation_id", "span_id"),
    "message": ("message", "msg", "event", "description", "text"),
}
# Syslog facility numbers and their names; 12 to 15 have none.
FACILITIES = {
    0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog", 6: "lpr", 7: "news", 8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp",
    16: "local0", 17: "local1", 18: "local2", 19: "local3", 20: "local4", 21: "local5", 22: "local6", 23: "local7",
}
# Names that a path may start with, and the column behind them; configurations use them.
PATH_NAMES = {
    "id": "id", "timestamp": "timestamp", "time": "timestamp", "source": "source_id", "source_id": "source_id", "host": "host", "hostname": "host",
    "severity": "severity", "level": "severity", "category": "category", "actor": "actor", "user": "actor", "resource": "resource",
    "trace": "trace_id", "trace_id": "trace_id", "tags": "tags", "attrs": "attrs",
}


def severity_number(text: str) -> int:
    """Severity of a configured name or number; ValueError if there is none."""
    s = str(text).strip().lower()
    if not s:
        return 2
    if s in SEVERITY_ALIASES:
        return SEVERITY_ALIASES[s]
    if s.isdigit() and int(s) <= 8:
        return int(s)
    raise ValueError(f"unknown severity {text!r}")
