"""Replays, restarts, the file source, bad records and deduplication of the running pipeline."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sluice import config as cfg
from sluice.operators import dedup
from sluice.sinks import writers
from sluice.sources import landing
from sluice.streaming.pipeline import Pipeline


def config(tmp_path, more="", sinks="[{id: files, type: file, path: OUT}]"):
    text = f"""
landing_dir: {tmp_path}/land
checkpoint_dir: {tmp_path}/check
dlq_dir: {tmp_path}/dlq
pipeline: {{default_sinks: [files]}}
sources: [{{id: in, type: http, listen: "127.0.0.1:0"}}, {{id: log, type: file, file: {tmp_path}/app.log, start_at: start, parser: kv}}]
sinks: {sinks.replace('OUT', f'{tmp_path}/out')}
{more}
"""
    return cfg.load(text)


def ids(spark, tmp_path):
    return sorted(json.loads(r["value"])["id"] for r in spark.read.text(f"{tmp_path}/out").collect())


def send(p, *events):
    p.landing.append("in", [json.dumps(e) for e in events])


def test_replay_and_restart(spark, tmp_path):
    p = Pipeline(spark, config(tmp_path))
    send(p, {"id": "1"}, {"id": "2"}, {"id": "3"})
    p.start(once=True).awaitTermination()
    assert ids(spark, tmp_path) == ["1", "2", "3"]
    assert p.replay(1)["accepted"] == 2
    assert ids(spark, tmp_path) == ["1", "2", "2", "3", "3"]
    again = Pipeline(spark, config(tmp_path, "# restarted"))
    assert (again.landing.end, again.landing.pending) == (2, 0)
    send(again, {"id": "4"}, {"id": "1"})
    again.start(once=True).awaitTermination()
    assert ids(spark, tmp_path) == ["1", "2", "2", "3", "3", "4"]
    assert again.metrics.value("pipeline_duplicates_total") == 1


def test_dead_letter_replay_adds(spark, tmp_path):
    p = Pipeline(spark, config(tmp_path))
    send(p, {"id": "1"}, {"id": "2"})
    p.start(once=True).awaitTermination()
    p.letters.add("files", spark.createDataFrame([("9", json.dumps({"id": "9"}), "down")], "id string, json string, error string"), 5)
    assert p.letters.sinks(spark) == ["files"]
    assert p.replay_dead_letters("files") == {"requeued": 1, "failed": 0}
    assert ids(spark, tmp_path) == ["1", "2", "9"] and p.replay_dead_letters("files") == {"requeued": 0, "failed": 0}


def test_file_source_and_bad_records(spark, tmp_path):
    (tmp_path / "app.log").write_text("id=a msg=one\nid=b msg=two\nid=c no end of line")
    p = Pipeline(spark, config(tmp_path))
    p.landing.append("in", ['{"id": "1"}\nnot json\n{"id": "2"}'])
    p.start(once=True).awaitTermination()
    assert ids(spark, tmp_path) == ["1", "2", "a", "b"]
    assert p.metrics.value("source_parse_errors_total", source="in") == 1 and p.metrics.value("source_received_total", source="log") == 2
    parts = p.letters.parts(spark, "source:in")
    assert [r["json"] for r in p.letters.read(spark, parts).collect()] != []
    with (tmp_path / "app.log").open("a") as f:
        f.write("\nid=d msg=four\n")
    again = Pipeline(spark, config(tmp_path))
    again.start(once=True).awaitTermination()
    assert ids(spark, tmp_path) == ["1", "2", "a", "b", "c", "d"]


def test_landing_bounds(tmp_path):
    zone = landing.Landing(str(tmp_path), max_pending=3, segment_bytes=10, max_segments=2)
    zone.append("s", ["x" * 6] * 4)
    assert len(list(tmp_path.glob("log-*.json"))) == 2
    with pytest.raises(landing.Saturated):
        zone.append("s", ["y"])
    zone.processed(1)
    again = landing.Landing(str(tmp_path), max_pending=3, max_segments=2)
    assert (again.end, again.pending) == (3, 2)
    again.append("s", ["z"])
    again.processed(3)
    again.append("s", ["z"])
    again.processed(5)  # files of what was processed before go
    assert sorted(int(p.stem.split("-")[2]) for p in tmp_path.glob("log-*.json")) == [4, 5]
    (tmp_path / ".log-torn.json.part").write_text("{")
    assert landing.Landing(str(tmp_path)).end == 5


def test_file_sink_generations(spark, tmp_path):
    import time

    sink = writers.FileWriter(cfg.SinkConfig(id="f", type="file", path=str(tmp_path / "o"), rotate_bytes=100, keep=2))
    row = lambda n: spark.createDataFrame([(str(n), None, "x" * 99)], "id string, timestamp timestamp, json string")
    for n in range(5):
        sink.write(row(n), n)
        time.sleep(1.1)
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["batch=000000000003", "batch=000000000004"]


def test_registered_sink(spark, tmp_path):
    seen = []

    class Listed:
        def write(self, rows, batch):
            seen.extend(r["id"] for r in rows.collect())

    writers.register("listed", lambda c, _: Listed())
    try:
        p = Pipeline(spark, config(tmp_path, sinks="[{id: files, type: listed}]"))
        send(p, {"id": "1"})
        p.start(once=True).awaitTermination()
        assert seen == ["1"]
        with pytest.raises(ValueError):
            writers.register("listed", lambda c, _: Listed())
    finally:
        writers.WRITERS.pop("listed")


def test_ttl_runs_against_a_walk(spark):
    import random

    rng, rows = random.Random(4), []
    for i in ("a", "b", "hot", "", None):
        t = 0
        for _ in range(300 if i == "hot" else 40):
            t += rng.choice((0, 1, 3, 9, 40, 200))
            rows.append((i, t))
    before = {"a": -30, "b": -5}
    want, last = [], dict(before)
    for i, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        ok = not i or i not in last or t - last[i] >= 50
        if i and ok:
            last[i] = t
        want.append((i or "", t, not ok))
    old = spark.createDataFrame(list(before.items()), "id string, last bigint")
    got = dedup.within_ttl(spark.createDataFrame(rows, "id string, us bigint").repartition(3), "us", 50, old)
    assert sorted(((r["id"] or "", r["us"], r["duplicate"]) for r in got.collect())) == sorted(want)
    assert got.where(F.col("id") == "hot").where(~F.col("duplicate")).count() > 20
