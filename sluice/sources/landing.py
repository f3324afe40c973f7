"""The landing zone: immutable files of payloads, which is also the write-ahead log.

A receiver collects payloads and writes them as one NDJSON file under a
temporary name, flushes it to disk and renames it; only then is the sender
told that they are accepted. Spark's file source reads whole files, so a
crash leaves either the whole file or nothing.

Each line: {"seq", "source_id", "payload", "received_us"}; seq rises within
the zone and tells replays where to begin.
"""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq BIGINT, source_id STRING, payload STRING, received_us BIGINT"


class Saturated(RuntimeError):
    """Too many files wait to be processed."""


class Landing:
    """``max_pending`` payloads may wait; a file has about ``segment_bytes`` of payload at most, of the processed ones the newest ``max_segments`` stay (0: all)."""

    def __init__(self, folder: str, max_pending: int = 0, clock=time.time, segment_bytes: int = 32 << 20, max_segments: int = 0):
        self.folder, self.max_pending, self.clock = Path(folder), max_pending, clock
        self.segment_bytes, self.max_segments = segment_bytes, max_segments
        self.folder.mkdir(parents=True, exist_ok=True)
        self._lock = threading.Lock()
        self._mark = self.folder / "_processed"  # hidden from Spark's file source
        self._done = int(self._mark.read_text() or -1) if self._mark.exists() else -1
        self._next = 1 + max((self._last(p) for p in self._files()), default=self._done)

    def _files(self) -> list[Path]:
        return sorted(self.folder.glob("log-*.json"))

    @staticmethod
    def _last(p: Path) -> int:
        return int(p.stem.split("-")[2])

    @property
    def end(self) -> int:
        """The last seq that has landed; -1 if there is none."""
        return self._next - 1

    @property
    def pending(self) -> int:
        return self._next - 1 - self._done

    def processed(self, seq: int) -> None:
        """Everything up to ``seq`` has been delivered; a restart knows it too. Older processed files go beyond ``max_segments``."""
        before = self._done
        if seq <= before:
            return
        part = self._mark.with_name("_processed.part")
        part.write_text(str(seq))
        os.replace(part, self._mark)
        self._done = seq
        if self.max_segments:
            self.prune(before + 1)

    def append(self, source_id: str, payloads: list[str]) -> int:
        """Land payloads durably; returns the last seq. Saturated if too many payloads are pending."""
        if not payloads:
            return self.end
        with self._lock:
            if self.max_pending and self.pending > self.max_pending:
                raise Saturated(f"{self.pending} payloads wait")
            at = 0
            while at < len(payloads):
                size, stop = 0, at
                while stop < len(payloads) and (stop == at or size < self.segment_bytes):
                    size += len(payloads[stop])
                    stop += 1
                self._write(source_id, payloads[at:stop])
                at = stop
            return self.end

    def _write(self, source_id: str, payloads: list[str]) -> None:
        first = self._next
        last = first + len(payloads) - 1
        now = int(self.clock() * 1e6)
        name = self.folder / f"log-{first:020d}-{last:020d}.json"
        part = name.with_name(f".{name.name}.part")
        try:
            with part.open("w", encoding="utf-8") as f:
                for n, p in enumerate(payloads):
                    f.write(json.dumps({"seq": first + n, "source_id": source_id, "payload": p, "received_us": now}) + "\n")
                f.flush()
                os.fsync(f.fileno())
            os.rename(part, name)
        except BaseException:
            part.unlink(missing_ok=True)
            raise
        self._next = last + 1

    def prune(self, keep_from: int) -> int:
        """Delete files whose last seq is below ``keep_from``, but for the newest ``max_segments`` files; returns how many."""
        old = [p for p in self._files() if self._last(p) < keep_from]
        spare = max(0, self.max_segments - (len(self._files()) - len(old)))
        gone = old[: len(old) - spare] if spare else old
        for p in gone:
            p.unlink()
        return len(gone)


def read(spark: SparkSession, folder: str, from_seq: int = 0, to_seq: int | None = None, limit: int | None = None) -> DataFrame:
    """Landed payloads in a range of seq, for replay; broken lines are left out.

    The range is closed above, so a replay never reads what it lands itself.
    """
    df = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder).where(F.col("seq") >= from_seq)
    if to_seq is not None:
        df = df.where(F.col("seq") <= to_seq)
    if limit is not None:
        df = df.orderBy("seq").limit(limit)
    return df


def stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)
