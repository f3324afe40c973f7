"""Tailing one growing file as a stream: the offset is a byte position.

Only whole lines are delivered, so a restart in the middle of a line loses
nothing: the position stands at the line's beginning. A file that has become
shorter is read again from the start. Positions live in the query's
checkpoint.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start_at = options.get("start_at", "end")
        self.max_line = int(options.get("max_line_bytes", 1 << 20))
        self.max_bytes = int(options.get("max_bytes_per_trigger", 64 << 20))

    def _size(self) -> int:
        try:
            return os.path.getsize(self.path)
        except OSError:
            return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0 if self.start_at == "start" else self._size()}

    def _lines(self, start: int, end: int) -> tuple[list[tuple[str]], int]:
        """Whole lines in [start, end) and where the last of them ends; a line over the limit is cut there."""
        try:
            with open(self.path, "rb") as f:
                f.seek(start)
                data = f.read(end - start)
        except OSError:
            return [], start
        whole = data.rfind(b"\n") + 1
        if whole == 0 and len(data) > self.max_line:
            whole = self.max_line
        rows = [(line.rstrip(b"\r").decode("utf-8", "replace"),) for line in data[:whole].split(b"\n")]
        return [r for r in rows if r[0].strip()], start + whole

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, size = start["at"], self._size()
        if size < at:
            at = 0
        rows, end = self._lines(at, min(size, at + self.max_bytes))
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        at = 0 if end["at"] < start["at"] else start["at"]
        return iter(self._lines(at, end["at"])[0])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "payload string"

    def simpleStreamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def stream(spark: SparkSession, path: str, start_at: str = "end", max_line_bytes: int = 1 << 20) -> DataFrame:
    """(payload): lines appended to ``path``."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("start_at", start_at).option("max_line_bytes", max_line_bytes).load()


class Follower:
    """Lands the lines of a configured file: the running pipeline's file source.

    The position is stored after its lines have landed, so a restart may land
    the last lines again but loses none. A full landing zone makes it wait.
    """

    def __init__(self, config, zone, metrics, offsets: str):
        options = {"path": config.file, "start_at": config.start_at, "max_line_bytes": config.max_line_bytes}
        self.config, self.zone, self.metrics, self.reader = config, zone, metrics, TailReader(options)
        self.file = Path(config.offsets_file or offsets)
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self.at = json.loads(self.file.read_text()) if self.file.exists() else self.reader.initialOffset()

    def poll(self) -> int:
        """Land what is new; the number of lines."""
        from sluice.sources.landing import Saturated

        landed = 0
        while True:
            rows, end = self.reader.read(self.at)
            lines = [r[0] for r in rows]
            if end == self.at:
                return landed
            try:
                self.zone.append(self.config.id, lines)
            except Saturated:
                self.metrics.add("source_saturated_total", source=self.config.id)
                return landed
            self.file.parent.mkdir(parents=True, exist_ok=True)
            part = self.file.with_name(self.file.name + ".part")
            part.write_text(json.dumps(end))
            os.replace(part, self.file)
            self.at, landed = end, landed + len(lines)
            self.metrics.add("source_received_total", len(lines), source=self.config.id)

    def start(self) -> Follower:
        def run() -> None:
            while not self._stop.is_set():
                self.poll()
                self._stop.wait(self.config.poll_interval)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def close(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
