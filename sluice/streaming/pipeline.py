"""The running engine: landing zone, parsing, dedup, rules, fan-out, delivery.

Each micro-batch is a plain DataFrame plan: payloads are parsed per source,
normalised, given ids, deduplicated, sent through the current rule set and
split by sink. Offsets, state and the batch id are in the checkpoint, so a
batch that fails is run again with the same rows. Rules are swapped between
batches, all or nothing.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.config import Config, SourceConfig
from sluice.operators import dedup, parsers, rules
from sluice.operators.enrich import Enricher
from sluice.operators.metrics import Registry, counters
from sluice.operators.normalize import attributed, canonical_json, ensure_id
from sluice.sinks import writers
from sluice.sinks.dlq import DeadLetters
from sluice.sources import landing, receivers, tail


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config, enricher: Enricher | None = None):
        self.spark, self.config, self.enricher = spark, config, enricher
        self.metrics = Registry()
        self.engine = config.engine(enricher)
        keep = config.wal.max_segments if config.wal.enabled else 1  # without a log only the newest processed file stays
        self.landing = landing.Landing(config.landing_dir, config.pipeline.queue_size, segment_bytes=config.wal.segment_bytes, max_segments=keep)
        self.letters = DeadLetters(config.dlq_dir)
        self.sinks = {s.id: writers.build(s, f"{config.checkpoint_dir}/deliveries") for s in config.sinks if s.enabled}
        self.failures: dict[str, str] = {}
        self._swap = threading.Lock()
        self.receivers: list[receivers.Receiver] = []
        self.query: StreamingQuery | None = None

    # rules

    def reload(self, specs: list[dict], sets: list[dict] | None = None) -> None:
        """Replace the rule set from the next batch on; InvalidRules leaves the old one."""
        sets = self.config.dlp if sets is None else sets
        engine = rules.Engine.of(specs, sets, self.enricher, {s.id for s in self.config.sinks})
        with self._swap:
            self.engine, self.config.rules, self.config.dlp = engine, specs, sets

    # one batch

    def parsed(self, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Events of landed payloads, with seq and received_us kept, and what could not be read: (source_id, payload, line, error)."""
        both = [self._parsed(payloads.where(F.col("source_id") == s.id), s) for s in self.config.sources if s.enabled]
        return ensure_id(reduce(DataFrame.unionByName, [e for e, _ in both])), reduce(DataFrame.unionByName, [x for _, x in both])

    def _parsed(self, payloads: DataFrame, s: SourceConfig) -> tuple[DataFrame, DataFrame]:
        options = parsers.Options(s.delimiter, s.header, s.columns, s.pattern)
        now = F.timestamp_micros("received_us")
        got = parsers.parse(payloads, s.parser, now, options)
        return attributed(got.events, s.id, s.category, tuple(dict.fromkeys(t.strip() for t in s.tags if t.strip()))), got.errors

    def unreadable(self, errors: DataFrame, batch_id: int | None) -> None:
        """Count what could not be parsed and keep it beside the dead letters, as sink ``source:<id>``."""
        errors = errors.persist()
        for r in errors.groupBy("source_id").count().collect():  # one row for each configured source
            self.metrics.add("source_parse_errors_total", r["count"], source=r["source_id"])
            own = errors.where(F.col("source_id") == r["source_id"])
            self.letters.add(f"source:{r['source_id']}", own.select(F.col("line").cast("string").alias("id"), F.col("payload").alias("json"), "error"), batch_id)
        errors.unpersist()

    def fresh(self, events: DataFrame, batch_id: int) -> DataFrame:
        """Without events whose id was accepted within the time to live, here or in an earlier batch.

        Accepted ids are kept in tables by batch, in the shared folder. A batch
        reads the acceptances of the last ``ttl`` before its first arrival;
        tables with nothing younger are deleted.
        """
        d = self.config.dedup
        if not d.enabled:
            return events
        folder = f"{self.config.checkpoint_dir}/accepted"
        ttl = int(d.ttl * 1e6)
        first = events.agg(F.min("received_us")).first()[0]
        schema = "id string, accepted_us bigint, batch bigint"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = self.spark.read.schema(schema).parquet(folder).where(F.col("batch") < batch_id)
            if first is not None:
                for r in known.groupBy("batch").agg(F.max("accepted_us").alias("last")).where(F.col("last") <= first - ttl).collect():  # one row for each kept batch
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={r['batch']}"), True)
                known = self.spark.read.schema(schema).parquet(folder).where((F.col("batch") < batch_id) & (F.col("accepted_us") > first - ttl))
        else:
            known = self.spark.createDataFrame([], schema)
        last = known.groupBy("id").agg(F.max("accepted_us").alias("last"))
        once = dedup.first_of_each(events, "id", "received_us", "seq")
        marked = dedup.within_ttl(once, "received_us", ttl, last).persist()
        kept = marked.where(~F.col("duplicate")).drop("duplicate").persist()
        kept.where("id <> ''").select("id", F.col("received_us").alias("accepted_us")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        self.metrics.add("pipeline_duplicates_total", events.count() - kept.count())
        marked.unpersist()
        return kept

    def deliver(self, events: DataFrame, batch_id: int) -> DataFrame:
        """Rules, fan-out and writes; the evaluated events."""
        with self._swap:
            engine = self.engine
        done = engine.evaluate(events).persist()
        sinks = list(self.sinks)
        out = rules.deliveries(done, self.config.pipeline.default_sinks, sinks).select("id", "timestamp", canonical_json().alias("json"), "sink", "delivered").persist()
        for name, sink in self.sinks.items():
            self._write(name, sink, out.where((F.col("sink") == name) & F.col("delivered")).select("id", "timestamp", "json"), batch_id)
        self._count(done, out)
        out.unpersist()
        return done

    def _write(self, name: str, sink: writers.Writer, rows: DataFrame, batch_id: int | None) -> int:
        """Deliver to one sink; a replay (no batch) writes beside what batches wrote, under a name of its own."""
        began = time.monotonic()
        try:
            failed = sink.write(rows, batch_id if batch_id is not None else f"replay-{uuid.uuid4().hex}")
            self.failures.pop(name, None)
        except Exception as e:  # noqa: BLE001  one sink's failure must not hold up the others
            self.failures[name] = str(e)[:500]
            failed = rows.select("id", "json", F.lit(str(e)[:500]).alias("error"))
        self.metrics.observe("sink_write_seconds", time.monotonic() - began, sink=name)
        if failed is None:
            return 0
        n = failed.count()
        if n:
            self.failures.setdefault(name, "deliveries failed")
            self.letters.add(name, failed, batch_id)
            self.metrics.add("sink_dead_lettered_total", n, sink=name)
        return n

    def _count(self, done: DataFrame, out: DataFrame) -> None:
        row = counters(done, failures=True).first()
        if row is not None:
            for k, v in row.asDict().items():
                self.metrics.add(f"pipeline_{k}_total", v or 0)
        for r in out.groupBy("sink", "delivered").count().collect():
            if r["delivered"]:
                self.metrics.add("sink_events_total", r["count"], sink=r["sink"])
            else:
                self.metrics.add("pipeline_unrouted_total", r["count"])

    def batch(self, payloads: DataFrame, batch_id: int) -> None:
        """What the stream runs for each micro-batch."""
        payloads, began = payloads.persist(), time.monotonic()
        try:
            events, errors = self.parsed(payloads)
            self.unreadable(errors, batch_id)
            events = events.persist()
            kept = self.fresh(events, batch_id)
            done = self.deliver(kept, batch_id)
            self.metrics.add("pipeline_ingested_total", done.count())
            for df in (done, kept, events):
                df.unpersist()
            last = payloads.agg(F.max("seq")).first()[0]
            if last is not None:
                self.landing.processed(last)
        finally:
            payloads.unpersist()
        self.metrics.observe("pipeline_processing_seconds", time.monotonic() - began)
        self.metrics.gauge("pipeline_queue_depth", self.landing.pending)

    # life cycle

    def start(self, once: bool = False) -> StreamingQuery:
        """Receivers and the stream; with ``once`` everything landed so far is processed and the query ends."""
        for s in self.config.sources:
            if s.enabled and s.type == "file":
                follower = tail.Follower(s, self.landing, self.metrics, f"{self.config.checkpoint_dir}/tail-{s.id}")
                follower.poll() if once else self.receivers.append(follower.start())
        if not once:
            for s in self.config.sources:
                if s.enabled and s.type in ("http", "webhook"):
                    self.receivers.append(receivers.http(s, self.landing, self.metrics))
                elif s.enabled and s.type == "syslog":
                    self.receivers.append(receivers.syslog(s, self.landing, self.metrics))
        writer = landing.stream(self.spark, self.config.landing_dir, self.config.pipeline.max_files_per_trigger).writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.config.checkpoint_dir}/stream")
        trigger = {"availableNow": True} if once else {"processingTime": f"{self.config.pipeline.trigger} seconds"}
        self.query = writer.trigger(**trigger).start()
        return self.query

    def stop(self) -> None:
        """Stop receiving, process what has landed, stop."""
        for r in self.receivers:
            r.close()
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()
            self.query.stop()

    # replay

    def replay(self, from_seq: int = 0, limit: int | None = None) -> dict[str, int]:
        """Landed payloads through the current rules again, past dedup, up to what has landed now."""
        payloads = landing.read(self.spark, self.config.landing_dir, from_seq, self.landing.end, limit).persist()
        events, _ = self.parsed(payloads)
        done = self.deliver(events, None)
        result = {"read": payloads.count(), "accepted": done.count(), "errors": len(self.failures)}
        self.metrics.add("pipeline_replayed_total", result["accepted"])
        done.unpersist()
        payloads.unpersist()
        return result

    def replay_dead_letters(self, sink: str) -> dict[str, int]:
        """Dead letters of a sink straight to it; letters that fail again are kept anew."""
        if sink not in self.sinks:
            raise KeyError(sink)
        parts = self.letters.parts(self.spark, sink)
        if not parts:
            return {"requeued": 0, "failed": 0}
        rows = self.letters.read(self.spark, parts).select("id", F.try_to_timestamp(F.get_json_object("json", "$.timestamp")).alias("timestamp"), "json").persist()
        total = rows.count()
        failed = self._write(sink, self.sinks[sink], rows, None)
        self.letters.clear(self.spark, parts)
        rows.unpersist()
        return {"requeued": total - failed, "failed": failed}

    # views

    def ready(self) -> tuple[bool, dict]:
        wrong = dict(self.failures)
        if self.query is not None and self.query.exception() is not None:
            wrong["stream"] = str(self.query.exception())[:300]
        return not wrong, wrong

    def stats(self) -> dict:
        progress = self.query.lastProgress if self.query is not None else None
        return {"metrics": self.metrics.snapshot(), "rules": [r.name for r in self.engine.rules], "sinks": list(self.sinks), "sink_errors": self.failures, "landed": self.landing.end + 1, "pending": self.landing.pending, "batch": progress["batchId"] if progress else None, "dedup": asdict(self.config.dedup)}
