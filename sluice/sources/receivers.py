"""Network receivers: HTTP, signed webhooks, syslog over UDP and TCP.

They only land payloads; parsing happens in Spark. Limits apply before
anything is kept: body size, line length.
"""

from __future__ import annotations

import gzip
import hashlib
import hmac
import json
import socketserver
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from sluice.config import SourceConfig
from sluice.operators.metrics import Registry
from sluice.sources.landing import Landing, Saturated

SIGNATURES = ("X-Sluice-Signature", "X-Hub-Signature-256")


def address(text: str) -> tuple[str, int]:
    host, _, port = text.rpartition(":")
    return host or "0.0.0.0", int(port)


def signed_by(secret: str, body: bytes, given: str) -> bool:
    """Whether ``given`` (hex, with or without ``sha256=``) is the body's HMAC."""
    want = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return bool(given) and hmac.compare_digest(want, given.strip().removeprefix("sha256="))


def readable(parser: str, text: str) -> bool:
    """Whether a payload of JSON kind has at least one record; other kinds are always landed."""
    if parser not in ("", "json", "ndjson"):
        return True
    for part in [text, *text.splitlines()]:
        try:
            if isinstance(json.loads(part), (dict, list, type(None))):
                return True
        except ValueError:
            continue
    return False


class Receiver:
    """A running server; ``port`` is where it listens."""

    def __init__(self, server: socketserver.BaseServer):
        self.server = server
        self.port = server.server_address[1]
        self.thread = threading.Thread(target=server.serve_forever, kwargs={"poll_interval": 0.05}, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def http(config: SourceConfig, landing: Landing, metrics: Registry) -> Receiver:
    """POST receiver; ``webhook`` sources check a signature, others a bearer secret if one is set."""
    path = config.path or ("/webhook" if config.type == "webhook" else "/ingest")
    labels = {"source": config.id}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict, **headers: str) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(raw)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/healthz":
                return self.answer(200, {"status": "ok", "source": config.id})
            return self.answer(405, {"error": "method not allowed"}, Allow="POST") if self.path == path else self.answer(404, {"error": "not found"})

        do_PUT = do_DELETE = do_PATCH = do_HEAD = do_GET  # noqa: N815

        def do_POST(self) -> None:  # noqa: N802
            if self.path.partition("?")[0] != path:
                return self.answer(404, {"error": "not found"})
            length = int(self.headers.get("Content-Length") or 0)
            if length > config.max_body_bytes:
                self.close_connection = True
                return self.answer(413, {"error": "body too large"})
            body = self.rfile.read(length)
            if config.type == "webhook":
                if not signed_by(config.secret, body, next((self.headers[h] for h in SIGNATURES if self.headers.get(h)), "")):
                    return self.answer(401, {"error": "bad signature"})
            elif config.secret and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {config.secret}"):
                return self.answer(401, {"error": "unauthorized"}, **{"WWW-Authenticate": "Bearer"})
            if self.headers.get("Content-Encoding", "").lower() == "gzip":
                d = zlib.decompressobj(31)
                try:
                    body = d.decompress(body, config.max_body_bytes + 1)
                except (zlib.error, gzip.BadGzipFile):
                    return self.answer(400, {"error": "not gzip"})
                if len(body) > config.max_body_bytes:
                    return self.answer(413, {"error": "body too large"})
            metrics.add("source_bytes_total", len(body), **labels)
            text = body.decode("utf-8", "replace")
            if not text.strip():
                return self.answer(202, {"accepted": 0, "source": config.id})
            if not readable(config.parser, text):
                metrics.add("source_parse_errors_total", **labels)
                return self.answer(400, {"error": "no record in the payload"})
            try:
                landing.append(config.id, [text])
            except Saturated:
                metrics.add("source_dropped_total", **labels)
                return self.answer(503, {"error": "saturated"}, **{"Retry-After": "1"})
            except OSError as e:
                metrics.add("source_errors_total", **labels)
                return self.answer(500, {"error": str(e)})
            metrics.add("source_payloads_total", **labels)
            return self.answer(202, {"accepted": 1, "source": config.id})

        def log_message(self, *args) -> None:
            pass

    return Receiver(ThreadingHTTPServer(address(config.listen), Handler))


def syslog(config: SourceConfig, landing: Landing, metrics: Registry) -> Receiver:
    """Datagrams, or newline-framed lines over TCP."""

    def land(text: str) -> None:
        try:
            landing.append(config.id, [text])
            metrics.add("source_payloads_total", source=config.id)
        except (Saturated, OSError):
            metrics.add("source_dropped_total", source=config.id)

    class Datagram(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            metrics.add("source_bytes_total", len(self.request[0]), source=config.id)
            if text := self.request[0].decode("utf-8", "replace").strip():
                land(text)

    class Lines(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            while raw := self.rfile.readline(config.max_line_bytes + 1):
                if len(raw) > config.max_line_bytes and not raw.endswith(b"\n"):
                    metrics.add("source_errors_total", source=config.id)
                    return
                metrics.add("source_bytes_total", len(raw), source=config.id)
                if text := raw.decode("utf-8", "replace").strip():
                    land(text)

    if config.network == "udp":
        server: socketserver.BaseServer = socketserver.ThreadingUDPServer(address(config.listen), Datagram)
        server.max_packet_size = 65536
    else:
        socketserver.ThreadingTCPServer.allow_reuse_address = True
        server = socketserver.ThreadingTCPServer(address(config.listen), Lines)
        server.daemon_threads = True
    return Receiver(server)
