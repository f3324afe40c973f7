"""Dead letters: one folder for each sink, one file set for each batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, json string, error string"


class DeadLetters:
    def __init__(self, folder: str):
        self.folder = folder

    def path(self, sink: str) -> str:
        return f"{self.folder}/sink={sink}"

    def add(self, sink: str, failed: DataFrame, batch_id: int | None = None) -> None:
        """Keep failed deliveries; a repeated batch replaces what it kept before."""
        name = f"batch-{batch_id:012d}" if batch_id is not None else f"replay-{uuid.uuid4().hex}"
        failed.write.mode("overwrite").json(f"{self.path(sink)}/{name}")

    def parts(self, spark: SparkSession, sink: str) -> list[str]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path(sink))
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        return [str(s.getPath().toString()) for s in fs.listStatus(hadoop) if s.isDirectory()] if fs.exists(hadoop) else []

    def read(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(parts).where(F.col("json").isNotNull())

    def clear(self, spark: SparkSession, parts: list[str]) -> None:
        """Delete exactly the parts that were read; letters added meanwhile stay."""
        for p in parts:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def sinks(self, spark: SparkSession) -> list[str]:
        """Sinks that have letters."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [str(s.getPath().getName()) for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.partition("=")[2] for n in names if n.startswith("sink="))
