"""Configuration: strict YAML, defaults, and all problems at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from sluice.operators.enrich import Enricher
from sluice.operators.rules import Engine, InvalidRules

UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
SIZES = {"": 1, "b": 1, "k": 1024, "kb": 1024, "kib": 1024, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}


class InvalidConfig(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def duration(value: Any) -> float:
    """Seconds of ``1h30m``, ``250ms``; a bare number is seconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    text = str(value).strip()
    if re.fullmatch(r"\d+(?:\.\d+)?", text):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {value!r}")
    return sum(float(n) * UNITS[u] for n, u in parts) * (-1 if text.startswith("-") else 1)


def byte_size(value: Any) -> int:
    """Bytes of ``8MiB``, ``1.5 kb``; KB and KiB are both 1024."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", str(value))
    if not m or m[2].lower() not in SIZES:
        raise ValueError(f"not a size: {value!r}")
    return int(float(m[1]) * SIZES[m[2].lower()])


@dataclass
class Server:
    addr: str = ":8080"
    token: str = ""


@dataclass
class PipelineConfig:
    workers: int = 4
    queue_size: int = 4096
    accept_timeout: float = field(default=5.0, metadata={"kind": "duration"})
    sink_queue_size: int = 8192
    shutdown_grace: float = field(default=10.0, metadata={"kind": "duration"})
    default_sinks: list[str] = field(default_factory=list)
    trigger: float = field(default=1.0, metadata={"kind": "duration"})
    max_files_per_trigger: int = 1000


@dataclass
class WalConfig:
    enabled: bool = True
    dir: str = "data/wal"
    segment_bytes: int = field(default=32 << 20, metadata={"kind": "size"})
    max_segments: int = 0
    sync_each: bool = False


@dataclass
class DedupConfig:
    enabled: bool = True
    ttl: float = field(default=600.0, metadata={"kind": "duration"})
    bloom_bits: int = 1 << 22
    hashes: int = 3
    drop_probable: bool = False


@dataclass
class RetryConfig:
    attempts: int = 5
    base: float = field(default=0.025, metadata={"kind": "duration"})
    max: float = field(default=2.0, metadata={"kind": "duration"})
    jitter: float = 0.2
    max_elapsed: float = field(default=0.0, metadata={"kind": "duration"})


@dataclass
class SourceConfig:
    id: str = ""
    type: str = ""
    enabled: bool = True
    listen: str = ""
    path: str = ""
    parser: str = "json"
    secret: str = ""
    network: str = "udp"
    file: str = ""
    start_at: str = "end"
    poll_interval: float = field(default=1.0, metadata={"kind": "duration"})
    offsets_file: str = ""
    max_body_bytes: int = field(default=8 << 20, metadata={"kind": "size"})
    max_line_bytes: int = field(default=1 << 20, metadata={"kind": "size"})
    category: str = ""
    tags: list[str] = field(default_factory=list)
    delimiter: str = ","
    header: bool = True
    columns: list[str] = field(default_factory=list)
    pattern: str = ""


@dataclass
class SinkConfig:
    id: str = ""
    type: str = ""
    enabled: bool = True
    path: str = ""
    url: str = ""
    headers: dict = field(default_factory=dict)
    brokers: list[str] = field(default_factory=list)
    topic: str = ""
    bucket: str = ""
    prefix: str = ""
    region: str = "us-east-1"
    endpoint: str = ""
    timeout: float = field(default=5.0, metadata={"kind": "duration"})
    batch_size: int = 100
    flush_interval: float = field(default=1.0, metadata={"kind": "duration"})
    buffer_size: int = 8192
    rotate_bytes: int = field(default=128 << 20, metadata={"kind": "size"})
    keep: int = 5
    retry: RetryConfig = field(default_factory=RetryConfig)


@dataclass
class EnrichConfig:
    key: str = ""


@dataclass
class Config:
    enrich: EnrichConfig = field(default_factory=EnrichConfig)
    server: Server = field(default_factory=Server)
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)
    wal: WalConfig = field(default_factory=WalConfig)
    dedup: DedupConfig = field(default_factory=DedupConfig)
    retry: RetryConfig = field(default_factory=RetryConfig)
    dlq_dir: str = "data/dlq"
    landing_dir: str = "data/landing"
    checkpoint_dir: str = "data/checkpoint"
    sources: list[SourceConfig] = field(default_factory=list)
    sinks: list[SinkConfig] = field(default_factory=list)
    dlp: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)

    def engine(self, enricher: Enricher | None = None) -> Engine:
        return Engine.of(self.rules, self.dlp, enricher, {s.id for s in self.sinks})


def _fill(kind, spec: Any, where: str, problems: list[str]):
    """An instance of a config dataclass; unknown keys and unreadable values become problems."""
    if spec is None:
        return kind()
    if not isinstance(spec, dict):
        problems.append(f"{where}: expected a mapping")
        return kind()
    known, values = {f.name: f for f in fields(kind)}, {}
    for k, v in spec.items():
        if k not in known:
            problems.append(f"{where}: unknown key {k!r}")
            continue
        f, at = known[k], f"{where}.{k}"
        try:
            if f.name in NESTED and kind in (Config, SinkConfig):
                values[k] = _fill(NESTED[f.name], v, at, problems)
            elif f.name in LISTS and kind is Config:
                values[k] = [_fill(LISTS[f.name], x, f"{at}[{n}]", problems) for n, x in enumerate(v or [])]
            elif f.metadata.get("kind") == "duration":
                values[k] = duration(v)
            elif f.metadata.get("kind") == "size":
                values[k] = byte_size(v)
            elif v is not None:
                values[k] = v
        except ValueError as e:
            problems.append(f"{at}: {e}")
    return kind(**values)


NESTED = {"enrich": EnrichConfig, "server": Server, "pipeline": PipelineConfig, "wal": WalConfig, "dedup": DedupConfig, "retry": RetryConfig}
LISTS = {"sources": SourceConfig, "sinks": SinkConfig}
SOURCE_TYPES = {"http", "webhook", "syslog", "file"}


def load(text: str, enricher: Enricher | None = None) -> Config:
    """Config of a YAML text; InvalidConfig with every problem."""
    problems: list[str] = []
    config = _fill(Config, parse_yaml(text), "config", problems)
    problems += check(config, enricher)
    if problems:
        raise InvalidConfig(problems)
    return config


def parse_yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError:  # JSON is a subset of YAML
        import json

        try:
            return json.loads(text) if text.strip() else None
        except ValueError as e:
            raise InvalidConfig([f"not JSON, and no YAML library is there: {e}"]) from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise InvalidConfig([f"not YAML: {e}"]) from e


def check(c: Config, enricher: Enricher | None = None) -> list[str]:
    """Problems of a filled configuration."""
    from sluice.operators.parsers import PARSERS
    from sluice.sinks.writers import WRITERS

    found: list[str] = []
    for kind, items, types in (("source", c.sources, SOURCE_TYPES), ("sink", c.sinks, set(WRITERS))):
        seen: set[str] = set()
        for n, x in enumerate(items):
            name = x.id or f"#{n}"
            if not x.id:
                found.append(f"{kind} {name}: no id")
            if x.id in seen:
                found.append(f"{kind} {name}: duplicate id")
            seen.add(x.id)
            if x.type not in types:
                found.append(f"{kind} {name}: unknown type {x.type!r}")
    for s in c.sources:
        if (s.parser or "json") not in PARSERS:
            found.append(f"source {s.id}: unknown parser {s.parser!r}")
        if s.type in ("http", "webhook", "syslog") and not s.listen:
            found.append(f"source {s.id}: no listen address")
        if s.type == "webhook" and not s.secret:
            found.append(f"source {s.id}: webhook without a secret")
        if s.type == "file" and not s.file:
            found.append(f"source {s.id}: no file")
        if s.type == "syslog" and s.network not in ("udp", "tcp"):
            found.append(f"source {s.id}: unknown network {s.network!r}")
        if s.start_at not in ("start", "end"):
            found.append(f"source {s.id}: start_at has to be start or end")
        if s.parser == "csv" and not s.header and not s.columns:
            found.append(f"source {s.id}: csv without a header needs columns")
        if s.parser == "csv" and len(s.delimiter) != 1:
            found.append(f"source {s.id}: csv delimiter has to be one character")
    needs = {"file": ("path",), "http": ("url",), "kafka": ("brokers", "topic"), "s3": ("bucket",)}
    for s in c.sinks:
        found += [f"sink {s.id}: no {k}" for k in needs.get(s.type, ()) if not getattr(s, k)]
    live = {s.id for s in c.sinks if s.enabled}
    found += [f"pipeline.default_sinks: unknown or disabled sink {s!r}" for s in c.pipeline.default_sinks if s not in live]
    if c.retry.attempts < 1:
        found.append("retry.attempts has to be 1 or more")
    try:
        Engine.of(c.rules, c.dlp, enricher, live)
    except InvalidRules as e:
        found += e.problems
    return found
