"""Control API, command line, generator, syslog receivers and plug-ins."""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.request

import pytest

from sluice import __main__, __version__, control, gen
from sluice import config as cfg
from sluice.operators import parsers
from sluice.operators.metrics import Registry
from sluice.operators.rules import Engine
from sluice.sources import landing, receivers


class Stub:
    """What the control plane asks of a pipeline."""

    def __init__(self):
        self.metrics, self.engine, self.asked = Registry(), Engine.of([{"name": "one"}]), []
        self.metrics.add("pipeline_ingested_total", 3)

    def ready(self):
        return False, {"sink": "down"}

    def stats(self):
        return {"landed": 7}

    def reload(self, specs, sets=None):
        self.engine = Engine.of(specs, sets)

    def replay(self, start, limit):
        self.asked.append((start, limit))
        return {"read": 2}

    def replay_dead_letters(self, sink):
        if sink != "s":
            raise KeyError(sink)
        return {"requeued": 1, "failed": 0}


def ask(port, path, method="GET", body=None, token="t"):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method=method)
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_control_api():
    stub = Stub()
    server = control.serve(stub, "127.0.0.1:0", "t")
    try:
        p = server.port
        assert ask(p, "/healthz")[0] == 200 and ask(p, "/readyz") == (503, json.dumps({"ready": False, "problems": {"sink": "down"}}))
        text = ask(p, "/metrics")[1]
        assert "pipeline_ingested_total 3" in text and "process_threads" in text and 'process_gc_collections{generation="0"}' in text
        assert json.loads(ask(p, "/stats")[1]) == {"landed": 7} and json.loads(ask(p, "/rules")[1]) == {"rules": ["one"]}
        assert ask(p, "/nowhere")[0] == 404 and ask(p, "/stats", "POST", {})[0] == 405
        assert ask(p, "/rules", "PUT", [{"name": "two"}], token="wrong")[0] == 401
        assert json.loads(ask(p, "/rules", "PUT", {"rules": [{"name": "two"}]})[1]) == {"rules": ["two"]}
        status, body = ask(p, "/rules", "PUT", [{"match": {"severity": "loud"}}])
        assert status == 400 and json.loads(body)["problems"] and stub.engine.rules[0].name == "two"
        assert ask(p, "/replay", "POST", {"from": 3, "limit": 2})[0] == 200 and stub.asked == [(3, 2)]
        assert json.loads(ask(p, "/dlq/replay", "POST", {"sink": "s"})[1]) == {"requeued": 1, "failed": 0}
        assert ask(p, "/dlq/replay", "POST", {"sink": "x"})[0] == 409 and ask(p, "/dlq/replay", "POST", {})[0] == 400
    finally:
        server.close()


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text("sinks: [{id: m, type: memory}]\nrules: [{name: r, actions: [{enrich: {output_field: attrs.x}}]}]\nenrich: {key: k}")
    bad.write_text("sinks: [{id: m, type: nowhere}]\nsources: [{id: s, type: file}]")
    assert __main__.main(["version"]) == 0 and __version__ in capsys.readouterr().out
    assert __main__.main(["check", str(good)]) == 0 and "1 sinks, 1 rules" in capsys.readouterr().out
    assert __main__.main(["check", str(bad)]) == 1
    assert "unknown type" in capsys.readouterr().err


def test_generator(spark):
    rows = gen.payloads(spark, 2500, per_payload=1000).collect()
    events = [json.loads(line) for r in rows for line in r["payload"].split("\n")]
    assert len(rows) == 3 and len({e["id"] for e in events}) == 2500
    assert {e["severity"] for e in events} == {name for name, _ in gen.LEVELS}


@pytest.mark.parametrize("network", ["udp", "tcp"])
def test_syslog(tmp_path, network):
    zone, metrics = landing.Landing(str(tmp_path)), Registry()
    r = receivers.syslog(cfg.SourceConfig(id="s", type="syslog", listen="127.0.0.1:0", network=network, max_line_bytes=50), zone, metrics)
    try:
        kind = socket.SOCK_DGRAM if network == "udp" else socket.SOCK_STREAM
        with socket.socket(socket.AF_INET, kind) as s:
            s.connect(("127.0.0.1", r.port))
            for line in (b"<13>one", b"<14>two", b"  "):
                s.send(line + b"\n")
            if network == "tcp":
                s.send(b"x" * 80 + b"\n")
            end = time.time() + 5
            while time.time() < end and (zone.end < 1 or network == "tcp" and not metrics.value("source_errors_total", source="s")):
                time.sleep(0.02)
    finally:
        r.close()
    landed = sorted(json.loads(x)["payload"] for p in tmp_path.glob("log-*.json") for x in p.read_text().splitlines())
    assert landed == ["<13>one", "<14>two"] and (network == "udp" or metrics.value("source_errors_total", source="s") == 1)


def test_registered_parser():
    parsers.register("mine", parsers.PARSERS["raw"])
    try:
        assert cfg.load("sources: [{id: a, type: http, listen: ':1', parser: mine}]").sources[0].parser == "mine"
        with pytest.raises(ValueError):
            parsers.register("mine", parsers.PARSERS["raw"])
    finally:
        parsers.PARSERS.pop("mine")
    with pytest.raises(cfg.InvalidConfig):
        cfg.load("sources: [{id: a, type: http, listen: ':1', parser: mine}]")
