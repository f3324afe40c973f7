"""Command line: run, check, gen, version."""

from __future__ import annotations

import argparse
import signal
import sys
import time
import urllib.request

from sluice import __version__


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check(path: str) -> int:
    from sluice.config import InvalidConfig, load
    from sluice.operators.enrich import HttpEnricher

    try:
        c = load(open(path, encoding="utf-8").read(), HttpEnricher())
    except InvalidConfig as e:
        print("\n".join(e.problems), file=sys.stderr)
        return 1
    print(f"ok: {len(c.sources)} sources, {len(c.sinks)} sinks, {len(c.rules)} rules")
    return 0


def run(path: str, once: bool) -> int:
    from sluice.config import load
    from sluice.control import serve
    from sluice.operators.enrich import HttpEnricher
    from sluice.streaming.pipeline import Pipeline

    config = load(open(path, encoding="utf-8").read(), HttpEnricher())
    enricher = HttpEnricher(config.enrich.key)
    pipeline = Pipeline(session(), config, enricher)
    query = pipeline.start(once)
    if once:
        query.awaitTermination()
        return 0
    control = serve(pipeline, config.server.addr, config.server.token)
    stopping: list[int] = []
    signal.signal(signal.SIGTERM, lambda s, _: stopping.append(s))
    signal.signal(signal.SIGINT, lambda s, _: stopping.append(s))

    def reload(*_) -> None:
        try:
            new = load(open(path, encoding="utf-8").read(), enricher)
            pipeline.reload(new.rules, new.dlp)
        except ValueError as e:
            print(f"rules kept: {e}", file=sys.stderr)

    if hasattr(signal, "SIGHUP"):
        signal.signal(signal.SIGHUP, reload)
    while not stopping and query.isActive:
        time.sleep(0.2)
    pipeline.stop()
    control.close()
    return 0


def gen(url: str, n: int, batch: int, secret: str) -> int:
    from sluice.gen import payloads

    sent = 0
    for row in payloads(session(), n, per_payload=batch).toLocalIterator():
        headers = {"Content-Type": "application/x-ndjson"} | ({"Authorization": f"Bearer {secret}"} if secret else {})
        with urllib.request.urlopen(urllib.request.Request(url, row["payload"].encode(), headers)) as r:
            sent += r.status == 202
    print(f"{sent} payloads accepted")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "check"):
        sub.add_parser(name).add_argument("config")
    sub.choices["run"].add_argument("--once", action="store_true")
    g = sub.add_parser("gen")
    g.add_argument("url")
    g.add_argument("-n", type=int, default=10_000)
    g.add_argument("--batch", type=int, default=1000)
    g.add_argument("--secret", default="")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "check":
        return check(a.config)
    if a.command == "run":
        return run(a.config, a.once)
    return gen(a.url, a.n, a.batch, a.secret)


if __name__ == "__main__":
    sys.exit(main())
