"""Sink writers.

A writer delivers the events of one sink in one micro-batch, as a DataFrame of
(id, timestamp, json). Delivery is at least once: a batch that is run again
writes to the same place (file and s3 sinks), or may send twice (http, kafka).
What can't be delivered is returned, for the dead letter queue.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import SinkConfig
from sluice.sinks.retry import Policy, Retryable

DELIVERY = "id string, timestamp timestamp, json string"
FAILED = "id string, json string, error string"


class Writer(Protocol):
    def write(self, rows: DataFrame, batch: int | str) -> DataFrame | None:
        """Deliver; the rows that failed, or None. ``batch`` is a batch's number, or a name of its own for a replay."""


def part_of(batch: int | str) -> str:
    return f"batch={batch:012d}" if isinstance(batch, int) else f"batch={batch}"


class FileWriter:
    """NDJSON files below a folder, one subfolder for each batch; a repeated batch replaces its own.

    Of the batches the newest stay that hold ``keep`` times ``rotate_bytes``
    (0: all); files have about that many bytes at most.
    """

    def __init__(self, config: SinkConfig):
        self.config = config

    def write(self, rows: DataFrame, batch: int | str) -> None:
        per_file = max(1, self.config.rotate_bytes // 512)
        rows.select(F.col("json").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(f"{self.config.path}/{part_of(batch)}")
        if self.config.keep:
            self._prune(rows.sparkSession)

    def _prune(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.config.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        parts = sorted((s for s in fs.listStatus(path) if s.isDirectory()), key=lambda s: s.getModificationTime(), reverse=True)
        held = 0
        for s in parts:
            if held >= self.config.keep * self.config.rotate_bytes:
                fs.delete(s.getPath(), True)
            else:
                held += fs.getContentSummary(s.getPath()).getLength()


class S3Writer:
    """Gzipped NDJSON partitioned by the time of writing, in any store that Spark writes to (``s3a://`` needs its library).

    A batch has a folder of its own, which a repeated batch replaces.
    """

    def __init__(self, config: SinkConfig, now=None):
        self.config, self.now = config, now

    def write(self, rows: DataFrame, batch: int | str) -> None:
        root = self.config.endpoint if self.config.endpoint.startswith(("file:", "/")) else f"s3a://{self.config.bucket}"
        now = F.current_timestamp() if self.now is None else self.now
        base = f"{root}/{self.config.prefix}".rstrip("/")
        parted = partitioned(rows, now)
        parted.select("dt", "hour", F.col("json").alias("value")).write.mode("overwrite").partitionBy("dt", "hour").option("compression", "gzip").text(f"{base}/{part_of(batch)}")


def partitioned(rows: DataFrame, at) -> DataFrame:
    """``rows`` with the partition columns dt and hour of a time."""
    return rows.withColumns({"dt": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")})


class KafkaWriter:
    """Key is the event id. Needs the Kafka connector on the class path."""

    def __init__(self, config: SinkConfig):
        self.config = config

    def write(self, rows: DataFrame, batch: int | str) -> None:
        rows.select(F.col("id").alias("key"), F.col("json").alias("value")).write.format("kafka").option("kafka.bootstrap.servers", ",".join(self.config.brokers)).option("topic", self.config.topic).save()


class HttpWriter:
    """POSTs NDJSON from the tasks, ``batch_size`` events at a time, each with retries."""

    def __init__(self, config: SinkConfig, folder: str):
        self.config, self.folder = config, folder

    def write(self, rows: DataFrame, batch: int | str) -> DataFrame:
        c = self.config
        policy = Policy(**vars(c.retry))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, c.batch_size):
                    part = b.slice(at, c.batch_size)
                    body = "".join(x + "\n" for x in part.column("json").to_pylist()).encode()
                    try:
                        policy.run(lambda body=body: post(c.url, body, c.headers, c.timeout))
                    except Exception as e:  # noqa: BLE001  any failure dead-letters the batch
                        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("json"), pa.array([str(e)] * part.num_rows)], ["id", "json", "error"])

        path = f"{self.folder}/http-{c.id}-{part_of(batch)}"
        rows.select("id", "json").mapInArrow(send, FAILED).write.mode("overwrite").parquet(path)  # sends once, whoever reads the failures how often
        return rows.sparkSession.read.schema(FAILED).parquet(path)


def post(url: str, body: bytes, headers: dict, timeout: float) -> None:
    """One attempt; network errors, 429 and 5xx are Retryable."""
    request = urllib.request.Request(url, body, {"Content-Type": "application/x-ndjson", **headers})
    try:
        urllib.request.urlopen(request, timeout=timeout).close()
    except urllib.error.HTTPError as e:
        kind = Retryable if e.code == 429 or e.code >= 500 else RuntimeError
        raise kind(f"HTTP {e.code}") from e
    except (urllib.error.URLError, OSError) as e:
        raise Retryable(str(e)) from e


class MemoryWriter:
    """A bounded ring on the driver: the newest ``buffer_size`` events."""

    def __init__(self, config: SinkConfig):
        self.bound, self.kept, self.total = config.buffer_size, [], 0

    def write(self, rows: DataFrame, batch: int | str) -> None:
        n = rows.count()
        newest = rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(self.bound).collect()
        self.kept = (self.kept + [r["json"] for r in reversed(newest)])[-self.bound :]
        self.total += n

    def recent(self, n: int = 0) -> list[str]:
        """The last n, oldest first; all for n <= 0."""
        return self.kept[-n:] if n > 0 else list(self.kept)


def recent(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows of a table by ``order``, oldest first."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


#: Writers by the type of their sink; each is made of (config, folder for its own records).
WRITERS: dict[str, Callable[[SinkConfig, str], Writer]] = {
    "file": lambda c, _: FileWriter(c),
    "s3": lambda c, _: S3Writer(c),
    "kafka": lambda c, _: KafkaWriter(c),
    "memory": lambda c, _: MemoryWriter(c),
    "http": HttpWriter,
}


def register(kind: str, make: Callable[[SinkConfig, str], Writer]) -> None:
    """Offer a further type of sink; configurations may name it from then on."""
    if kind in WRITERS:
        raise ValueError(f"sink type {kind!r} is taken")
    WRITERS[kind] = make


def build(config: SinkConfig, folder: str) -> Writer:
    return WRITERS[config.type](config, folder)
