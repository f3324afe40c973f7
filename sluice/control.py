"""The control plane: a small HTTP server beside the driver."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from sluice.config import InvalidConfig, parse_yaml
from sluice.operators.metrics import runtime
from sluice.operators.rules import InvalidRules
from sluice.sources.receivers import Receiver, address

METHODS = {"/healthz": ("GET",), "/readyz": ("GET",), "/metrics": ("GET",), "/stats": ("GET",), "/rules": ("GET", "PUT", "POST"), "/replay": ("POST",), "/dlq/replay": ("POST",)}


def serve(pipeline, addr: str, token: str = "") -> Receiver:
    """Serve health, metrics, stats, rules and replays; changes need the bearer token if one is set."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict | list | str, **headers: str) -> None:
            raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            kind = "text/plain; version=0.0.4" if isinstance(body, str) else "application/json"
            for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def handle_any(self) -> None:
            path = self.path.partition("?")[0]
            if path not in METHODS:
                return self.answer(404, {"error": "not found"})
            if self.command not in METHODS[path]:
                return self.answer(405, {"error": "method not allowed"}, Allow=", ".join(METHODS[path]))
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if self.command != "GET" and token and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}"):
                return self.answer(401, {"error": "unauthorized"})
            try:
                return getattr(self, "on" + path.replace("/", "_"))(body)
            except (InvalidRules, InvalidConfig) as e:
                return self.answer(400, {"error": "invalid rules", "problems": e.problems})
            except KeyError as e:
                return self.answer(409, {"error": f"unknown sink {e}"})
            except ValueError as e:
                return self.answer(400, {"error": str(e)})

        do_GET = do_PUT = do_POST = do_DELETE = do_PATCH = handle_any  # noqa: N815

        def on_healthz(self, _: str) -> None:
            self.answer(200, {"status": "ok"})

        def on_readyz(self, _: str) -> None:
            ok, wrong = pipeline.ready()
            self.answer(200 if ok else 503, {"ready": ok, "problems": wrong})

        def on_metrics(self, _: str) -> None:
            runtime(pipeline.metrics)
            self.answer(200, pipeline.metrics.exposition())

        def on_stats(self, _: str) -> None:
            self.answer(200, pipeline.stats())

        def on_rules(self, body: str) -> None:
            if self.command != "GET":
                got = parse_yaml(body)
                specs = got.get("rules") if isinstance(got, dict) else got
                if not isinstance(specs, list):
                    return self.answer(400, {"error": "expected a list of rules"})
                pipeline.reload(specs, got.get("dlp") if isinstance(got, dict) else None)
            self.answer(200, {"rules": [r.name for r in pipeline.engine.rules]})

        def on_replay(self, body: str) -> None:
            asked = json.loads(body) if body.strip() else {}
            self.answer(200, pipeline.replay(int(asked.get("from", 0)), int(asked["limit"]) if asked.get("limit") else None))

        def on_dlq_replay(self, body: str) -> None:
            asked = json.loads(body) if body.strip() else {}
            if not asked.get("sink"):
                return self.answer(400, {"error": "no sink"})
            self.answer(200, pipeline.replay_dead_letters(asked["sink"]))

        def log_message(self, *args) -> None:
            pass

    return Receiver(ThreadingHTTPServer(address(addr), Handler))
