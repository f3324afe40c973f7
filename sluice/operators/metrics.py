"""Counters and histograms of event tables, and their text exposition."""

from __future__ import annotations

import gc
import resource
import threading
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STARTED = time.time()
# The default histogram bounds, in seconds.
BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def counters(evaluated: DataFrame, *by: str, failures: bool = False) -> DataFrame:
    """Events, drops by reason, redactions, enrichments and (if asked for) those that failed, in one pass."""
    count = lambda c: F.count(F.when(c, 1))
    return evaluated.groupBy(*by).agg(
        F.count("*").alias("events"),
        count(F.col("drop_reason") == "rule").alias("rules_dropped"),
        count(F.col("drop_reason") == "sampled").alias("sampled_out"),
        F.sum("redacted").cast("bigint").alias("redactions"),
        F.sum("enriched").cast("bigint").alias("enrichments"),
        *([F.sum("enrich_failed").cast("bigint").alias("enrich_failures")] if failures else []),
    )


def histogram(df: DataFrame, value: Column, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts of values up to each bound, the count and the sum, in one pass."""
    parts = [F.count(F.when(value <= b, 1)).alias(f"le_{n}") for n, b in enumerate(bounds)]
    row = df.agg(*parts, F.count(value).alias("n"), F.sum(value).alias("total"))
    listed = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{n}").alias("cumulative")) for n, b in enumerate(bounds)))
    return row.select(F.explode(listed).alias("x"), "n", "total").select("x.le", "x.cumulative", "n", "total")


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace("\n", "\\n").replace('"', '\\"')


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def runtime(registry: Registry) -> None:
    """Gauges of the driver's process."""
    usage = resource.getrusage(resource.RUSAGE_SELF)
    registry.gauge("process_start_time_seconds", STARTED, "When the process began")
    registry.gauge("process_cpu_seconds_total", usage.ru_utime + usage.ru_stime, "CPU time used")
    registry.gauge("process_max_resident_bytes", usage.ru_maxrss * 1024, "Most memory held so far")
    registry.gauge("process_threads", threading.active_count(), "Python threads")
    for generation, s in enumerate(gc.get_stats()):
        registry.gauge("process_gc_collections", s["collections"], "Garbage collections", generation=str(generation))


class Registry:
    """Process-wide series for the control plane."""

    def __init__(self) -> None:
        self._lock, self._help, self._kind, self._series, self._bounds = threading.Lock(), {}, {}, {}, {}

    def _at(self, kind: str, name: str, labels: dict, help: str):  # noqa: A002
        self._help.setdefault(name, help)
        self._kind.setdefault(name, kind)
        return name, tuple(sorted(labels.items()))

    def add(self, name: str, by: float = 1, help: str = "", **labels: str) -> None:  # noqa: A002
        """Raise a counter; negative amounts are ignored."""
        if by < 0:
            return
        with self._lock:
            key = self._at("counter", name, labels, help)
            self._series[key] = self._series.get(key, 0) + by

    def gauge(self, name: str, value: float, help: str = "", **labels: str) -> None:  # noqa: A002
        with self._lock:
            self._series[self._at("gauge", name, labels, help)] = value

    def observe(self, name: str, value: float, bounds: tuple[float, ...] = BOUNDS, help: str = "", **labels: str) -> None:  # noqa: A002
        with self._lock:
            key = self._at("histogram", name, labels, help)
            self._bounds[name] = bounds
            counts, total, n = self._series.get(key, ([0] * len(bounds), 0.0, 0))
            self._series[key] = ([c + (value <= b) for c, b in zip(counts, bounds, strict=True)], total + value, n + 1)

    def value(self, name: str, **labels: str) -> float:
        return self._series.get((name, tuple(sorted(labels.items()))), 0)

    def snapshot(self) -> dict[str, float]:
        with self._lock:
            return {name + ("{" + ",".join(f"{k}={v}" for k, v in labels) + "}" if labels else ""): v for (name, labels), v in self._series.items() if self._kind[name] != "histogram"}

    def exposition(self) -> str:
        """Prometheus text, families and series sorted."""
        out: list[str] = []
        with self._lock:
            for name in sorted(self._kind):
                if self._help[name]:
                    out.append(f"# HELP {name} {self._help[name]}")
                out.append(f"# TYPE {name} {self._kind[name]}")
                for (n, labels), v in sorted((x for x in self._series.items() if x[0][0] == name), key=lambda x: x[0]):
                    show = lambda extra=(): "{" + ",".join(f'{k}="{_escaped(str(w))}"' for k, w in (*labels, *extra)) + "}" if labels or extra else ""  # noqa: B023, E731
                    if self._kind[name] != "histogram":
                        out.append(f"{n}{show()} {_number(v)}")
                        continue
                    counts, total, count = v
                    out += [f"{n}_bucket{show((('le', _number(b)),))} {c}" for b, c in zip(self._bounds[name], counts, strict=True)]
                    out += [f'{n}_bucket{show((("le", "+Inf"),))} {count}', f"{n}_sum{show()} {_number(total)}", f"{n}_count{show()} {count}"]
        return "\n".join(out) + "\n"
