"""Cases that SQL twins don't reach: parsers' odd inputs, actions, state, delivery, configuration."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sluice import config as cfg
from sluice.functions import hashing, regexes, values
from sluice.operators import matchers, parsers, redact, rules
from sluice.operators.metrics import Registry
from sluice.sinks.retry import Policy, Retryable
from sluice.sources import landing, receivers



def parsed(spark, name, payload, **options):
    df = spark.createDataFrame([("s", payload)], "source_id string, payload string")
    got = parsers.parse(df, name, F.lit("2024-03-01 12:00:00").cast("timestamp"), parsers.Options(**options))
    return [r.asDict() | {"attrs": json.loads(r["j"])} for r in got.events.select("*", F.to_json("attrs").alias("j")).drop("attrs").collect()], [r.asDict() for r in got.errors.collect()]


def event(spark, **over):
    base = {"id": "e1", "host": "h1", "category": "auth", "actor": "bob", "severity": 4, "attrs": {"status": 503, "latency_ms": 12.5}, "tags": ["t"], "resource": ""} | over
    row = (base["id"], datetime(2024, 1, 1, tzinfo=UTC), "src", base["host"], base["severity"], base["category"], base["actor"], base["resource"], "", json.dumps(base["attrs"]), base["tags"])
    df = spark.createDataFrame([row], "id string, timestamp timestamp, source_id string, host string, severity int, category string, actor string, resource string, trace_id string, a string, tags array<string>")
    return df.withColumn("attrs", F.from_json("a", "map<string,variant>")).drop("a").withColumn("received_at", F.col("timestamp"))


@pytest.mark.parametrize(
    ("payload", "events", "errors"),
    [
        ('{"a":1}', 1, 0), ("  \n ", 0, 0), ('[{"a":1},{"a":2}]', 2, 0), ('[{"a":1},5]', 0, 1), ('{"a":1}\n{"a":2}', 2, 0), ('{"a":1}\nnope\n{"a":3}', 2, 1), ("garbage", 0, 1),
        ('{\n "a": 1,\n "b": {"c": 2}\n}', 1, 0), ("null", 1, 0), ('{"a":1,"a":2}', 1, 0), ("[", 0, 1), ('{"a"', 0, 1), ("5", 0, 1),
    ],
)
def test_json_shapes(spark, payload, events, errors):
    good, bad = parsed(spark, "json", payload)
    assert (len(good), len(bad)) == (events, errors)
    if "nope" in payload:
        assert bad[0]["line"] == 2


def test_aliases_and_losers(spark):
    good, _ = parsed(spark, "json", '{"@timestamp":"2024-01-02T03:04:05Z","level":"warn","hostname":"h","node":"n","user":"u","trace_id":"t","msg":"m","status":503,"big":12345678901234567890}')
    e = good[0]
    assert (e["severity"], e["host"], e["actor"], e["trace_id"]) == (4, "h", "u", "t")
    assert e["attrs"]["message"] == "m" and e["attrs"]["node"] == "n" and e["attrs"]["status"] == 503 and e["attrs"]["big"] == 12345678901234567890


def test_csv_and_kv(spark):
    good, _ = parsed(spark, "csv", 'level;host;message\nerror;h;"a;b\nc"\nwarn;x', delimiter=";")
    assert [(e["severity"], e["host"], e["attrs"].get("message")) for e in good] == [(5, "h", "a;b\nc"), (4, "x", None)]
    _, bad = parsed(spark, "csv", 'a,b\n"open')
    assert len(bad) == 1
    good, _ = parsed(spark, "kv", 'level=warn host="a b" e="" msg=\'x y\' n=1 n=2\nnothing here')
    assert len(good) == 1 and good[0]["host"] == "a b" and good[0]["attrs"] == {"e": '""', "message": "x y", "n": "2"}
    with pytest.raises(ValueError):
        parsed(spark, "csv", "x", header=False)


def test_syslog(spark):
    lines = "\n".join(["<34>1 2024-01-02T03:04:05Z h app 12 ID [x@1 k=\"[v]\"] hello", "<13>Feb  5 10:00:00 web sshd[77]: hi there", "just a bare message", "<999>odd", "<13>Dec 31 10:00:00 web cron: late"])
    good, _ = parsed(spark, "syslog", lines)
    a, b, c, d, e = good
    assert (a["severity"], a["host"], a["category"], a["attrs"]["facility_name"], a["attrs"]["structured_data"], a["attrs"]["message"]) == (6, "h", "app", "auth", '[x@1 k="[v]"]', "hello")
    assert (b["severity"], b["host"], b["category"], b["attrs"]["procid"], b["attrs"]["message"], b["timestamp"]) == (3, "web", "sshd", "77", "hi there", datetime(2024, 2, 5, 10))
    assert c["attrs"]["message"] == "just a bare message" and c["severity"] == 2
    assert d["attrs"]["message"] == "<999>odd"
    assert e["timestamp"] == datetime(2023, 12, 31, 10)


def test_value_texts(spark):
    cases = {"1": "1", "1.50": "1.5", "true": "true", "null": "", '"x"': "x", "[1,\"a\",null]": "[1 a <nil>]", '{"b":1,"a":[2]}': "map[a:[2] b:1]", "1e21": "1000000000000000000000", "0.1": "0.1"}
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", values.variant_text(F.parse_json("j")).alias("t"))
    assert {r["j"]: r["t"] for r in df.collect()} == cases


def test_matchers_never_null(spark):
    e = event(spark)
    cases = [({"field": "attrs.nope", "equals": "x"}, False), ({"not": {"field": "attrs.nope", "equals": "x"}}, True), ({"field": "attrs.status", "equals": 503}, True), ({"field": "severity", "equals": "warning"}, True), ({"field": "severity", "gt": 1}, False), ({"field": "attrs.latency_ms", "gt": 10, "lt": 13}, True), ({"field": "nonsense", "absent": True}, True), ({"field": "tags", "contains": "t"}, True), ({}, True), ({"field": "attrs.status", "in": [503]}, True)]
    got = e.select(*(matchers.compile(matchers.Matcher.of(m)).alias(f"c{n}") for n, (m, _) in enumerate(cases))).first()
    assert list(got) == [w for _, w in cases]


def test_every_one_keeps_and_small_percent(spark):
    e = event(spark)
    keep = rules.Engine.of([{"actions": [{"sample": {"every": 1}}]}]).evaluate(e).first()
    assert keep["alive"]
    gone = rules.Engine.of([{"name": "r", "actions": [{"sample": {"percent": 0.01}}]}]).evaluate(e).first()
    assert (gone["alive"], gone["drop_reason"], gone["drop_rule"]) == (False, "sampled", "r")


def test_sampling_hash(spark):
    def model(s):
        h, m = hashing.FNV_BASIS, (1 << 64) - 1
        for b in s.encode():
            h = (h ^ b) * hashing.FNV_PRIME & m
        h = (h ^ h >> 30) * hashing.MIX_1 & m
        h = (h ^ h >> 27) * hashing.MIX_2 & m
        return h ^ h >> 31

    ids = ["", "a", "event-1", "é", "x" * 300]
    df = hashing.with_roll(spark.createDataFrame([(i,) for i in ids], "id string"), "r", F.col("id"))
    assert {r["id"]: r["r"] % (1 << 64) for r in df.collect()} == {i: model(i) for i in ids}


def test_nested_redaction_counts(spark):
    attrs = {"message": "mail a@b.cc", "deep": {"l": ["x@y.zz", 1, {"m": "q@r.ss", "n": {"o": {"p": "d@e.ff"}}}]}, "password": "p", "n": 5}
    r = rules.Engine.of([{"actions": [{"redact": "default"}]}]).evaluate(event(spark, attrs=attrs, host="h@i.jj")).select("host", "redacted", F.to_json("attrs").alias("j")).first()
    assert "@" not in r["j"] and r["host"] == "[redacted:email]"
    assert json.loads(r["j"])["password"] == "[redacted:password]" and r["redacted"] == 6


def test_invalid_rules_report_everything():
    bad = [{"name": "a", "match": {"regex": "(", "field": "host"}}, {"name": "a", "match": {"severity": "loud"}, "actions": [{"redact": "none"}, {"sample": {}}, {"sample": {"percent": 200}}, {"enrich": {"model": "m"}}]}]
    with pytest.raises(rules.InvalidRules) as e:
        rules.Engine.of(bad)
    assert len(e.value.problems) >= 7


def test_enrichment(spark):
    class Echo:
        def ask(self, spec, text):
            if "bad" in text:
                raise RuntimeError("down")
            return f" {text.upper()} "

    spec = [{"actions": [{"enrich": {"output_field": "attrs.label", "fallback": "none"}}]}]
    out = lambda m: rules.Engine.of(spec, enricher=Echo()).evaluate(event(spark, attrs=m)).select("enriched", F.to_json("attrs").alias("j")).first()
    ok, failed, blank = out({"message": "hi"}), out({"message": "bad"}), out({})
    assert (ok["enriched"], json.loads(ok["j"])) == (1, {"message": "hi", "label": "HI", "enrichment_source": "llm"})
    assert (failed["enriched"], json.loads(failed["j"])) == (0, {"message": "bad", "label": "none", "enrichment_source": "fallback"})
    assert json.loads(blank["j"]) == {}


@pytest.mark.parametrize(("pattern", "text", "hit"), [(r"\b1234", "é1234", True), ("a.b", "a\rb", True), ("x$", "x\n", False), (r"\s", "\v", False), (r"(?P<a_b>x)", "x", True), (r"[[:alpha:]]+\d", "ab1", True), (r"[^\]]a", "xa", True)])
def test_re2_dialect(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(regexes.to_java(pattern))).first()[0] is hit


def test_retry_policy():
    p, waits, calls = Policy(attempts=5, base=0.01, max=0.04, jitter=0), [], []

    def work():
        calls.append(1)
        raise Retryable("x")

    with pytest.raises(Retryable):
        p.run(work, waits.append)
    assert waits == [0.01, 0.02, 0.04, 0.04] and len(calls) == 5
    with pytest.raises(ValueError):
        p.run(lambda: int("x"))


def test_config_problems_and_units():
    with pytest.raises(cfg.InvalidConfig) as e:
        cfg.load("sources: [{id: a, type: nope}, {id: a, type: http}]\nsinks: [{id: s, type: file}]\nwat: 1\nrules: [{actions: [{route: x}]}]\ndedup: {ttl: soon}")
    assert len(e.value.problems) >= 6
    assert cfg.duration("1h30m") == 5400 and cfg.duration(5) == 5 and cfg.byte_size("1.5KiB") == 1536
    ok = cfg.load("dedup: {ttl: 5m}")
    assert ok.dedup.ttl == 300 and ok.wal.enabled and ok.pipeline.queue_size == 4096


def test_metrics_exposition():
    r = Registry()
    r.add("a_total", 2, help="As", kind='q"x')
    r.add("a_total", -1, kind='q"x')
    for v in (0.05, 0.3, 2):
        r.observe("h", v, (0.1, 0.5, 1))
    text = r.exposition()
    assert 'a_total{kind="q\\"x"} 2' in text and 'h_bucket{le="0.1"} 1' in text and 'h_bucket{le="1"} 2' in text and "h_count 3" in text


def post(port, body, path="/ingest", **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body, headers)) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


def test_http_receiver(tmp_path):
    import gzip

    zone = landing.Landing(str(tmp_path), max_pending=4)
    r = receivers.http(cfg.SourceConfig(id="in", type="http", listen="127.0.0.1:0", secret="s", max_body_bytes=100), zone, Registry())
    try:
        auth = {"Authorization": "Bearer s"}
        assert post(r.port, b"{}") == 401
        assert post(r.port, b'{"a":1}', **auth) == 202
        assert post(r.port, gzip.compress(b'{"a":2}'), **auth, **{"Content-Encoding": "gzip"}) == 202
        assert post(r.port, b"junk", **auth) == 400
        assert post(r.port, b"x" * 200, **auth) == 413
        assert post(r.port, b"  ", **auth) == 202
        assert [post(r.port, b'{"a":3}', **auth) for _ in range(4)][-1] == 503
    finally:
        r.close()
    assert len(list(tmp_path.glob("log-*.json"))) >= 3


def test_webhook_signature():
    import hashlib
    import hmac

    sig = hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert receivers.signed_by("k", b"body", sig) and receivers.signed_by("k", b"body", f"sha256={sig}") and not receivers.signed_by("k", b"body", "")


def test_pipeline_end_to_end(spark, tmp_path):
    from sluice.streaming.pipeline import Pipeline

    text = f"""
landing_dir: {tmp_path}/land
checkpoint_dir: {tmp_path}/check
dlq_dir: {tmp_path}/dlq
pipeline: {{default_sinks: [mem]}}
sources: [{{id: in, type: http, listen: "127.0.0.1:0", tags: [x]}}]
sinks:
  - {{id: mem, type: memory}}
  - {{id: files, type: file, path: {tmp_path}/out}}
  - {{id: dead, type: http, url: "http://127.0.0.1:1/", retry: {{attempts: 1}}}}
rules:
  - {{name: drop, match: {{field: category, equals: noise}}, actions: [{{drop: true}}]}}
  - {{name: hide, actions: [{{redact: default}}]}}
  - {{name: loud, match: {{severity: error}}, actions: [{{route: [files, dead]}}]}}
"""
    p = Pipeline(spark, cfg.load(text))
    send = lambda *events: p.landing.append("in", ["\n".join(json.dumps(e) for e in events)])
    send({"id": "1", "type": "noise"}, {"id": "2", "msg": "a@b.cc"}, {"id": "3", "level": "error"})
    send({"id": "2", "msg": "again"})
    p.start(once=True).awaitTermination()
    assert [json.loads(x)["id"] for x in p.sinks["mem"].recent()] == ["2"]
    assert "[redacted:email]" in p.sinks["mem"].recent()[0]
    written = [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert [json.loads(x)["id"] for x in written] == ["3"]
    assert p.metrics.value("sink_dead_lettered_total", sink="dead") == 1
    assert p.replay_dead_letters("dead") == {"requeued": 0, "failed": 1}
    assert not p.ready()[0]
    with pytest.raises(rules.InvalidRules):
        p.reload([{"actions": [{"route": "nowhere"}]}])
    p.reload([{"name": "all", "actions": [{"route": "mem"}]}])
    assert p.replay()["accepted"] == 4
    assert p.stats()["rules"] == ["all"]


def test_csv_is_read_in_slices(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sluice.operators import parsers

    texts = pd.Series(["x" * n for n in [10] * 700 + [3 << 20, 0, 5]])
    cut = list(parsers.slices(texts))
    assert pd.concat(cut).tolist() == texts.tolist() and max(map(len, cut)) == 256
    assert all(len(c) == 1 or c.str.len().sum() <= 1 << 20 for c in cut)
    payloads = [("s", f"id,k,,k\n{n},a,b,c{n}\n{n + 1000},d") for n in range(600)] + [("s", 'id\n"open')]
    got = parsers.parse(spark.createDataFrame(payloads, "source_id string, payload string").coalesce(1), "csv", F.lit("2024-06-01").cast("timestamp"))
    rows = {(r["id"], r["k"]) for r in got.events.select("id", F.try_variant_get(F.col("attrs")["k"], "$", "string").alias("k")).collect()}
    assert rows == {(str(n), f"c{n}") for n in range(600)} | {(str(n + 1000), "d") for n in range(600)}
    assert got.errors.count() == 1


def test_events_of_one_split_are_dealt_to_all_cores(spark):
    from pyspark.sql import functions as F

    from sluice.plans.views import ev

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which joins small partitions again
    try:
        rows = ev(spark, "/root/testdata/sf0.001").select("id", F.spark_partition_id().alias("p"))
        assert rows.select("p").distinct().count() > 1 and rows.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_filters_do_not_copy_the_redaction(spark):
    from sluice.operators import rules
    from sluice.plans import catalogue
    from sluice.plans.views import ev

    done = rules.Engine.of(catalogue.FLAGSHIP).evaluate(ev(spark, "/root/testdata/sf0.001"))
    plan = done.where("alive AND array_contains(tags, 'large')").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "AKIA[" in line]
