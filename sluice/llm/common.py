"""Shared pieces of the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which driver and executors share; where the setting
is absent (tests) they go below the warehouse.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str = "t") -> str:
    """A fresh path in the shared folder; nothing is created."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/sluice-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads it again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sluice-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of 8 to 24 bytes that may be sent to every task (some tens of MB).
SMALL = 1_000_000
#: Rows of a file are counted in blocks of 2 to the power of this.
BLOCK = 14


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a stored table of narrow rows, marked to be sent to every task if it has ``SMALL`` rows at most; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def marked_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], how: str, send: bool | None = None) -> DataFrame:
    """Join on two bigint columns of the same names, kept from the left.

    The key is one hash of both, which Spark keeps in a compact map where it
    broadcasts, and the columns themselves are compared behind it. ``send``
    says whether the right side is broadcast; else its rows decide.
    """
    a, b = keys
    h, ra, rb = (fresh([*left.columns, *right.columns], n) for n in ("_join", "_join_a", "_join_b"))
    own = left.withColumn(h, F.xxhash64(a, b))
    other = right.withColumnRenamed(a, ra).withColumnRenamed(b, rb).withColumn(f"{h}_r", F.xxhash64(ra, rb))
    if send or send is None and right.count() <= SMALL:
        other = F.broadcast(other)
    same = (F.col(h) == F.col(f"{h}_r")) & (F.col(a).bitwiseXOR(F.col(ra)) == 0) & (F.col(b).bitwiseXOR(F.col(rb)) == 0)
    done = own.join(other, same, how)
    return done.drop(h) if how in ("left_anti", "left_semi") else done.drop(h, f"{h}_r", ra, rb)


class Part:
    """Rows of a table with places: of some files, of each a range of rows; ``n`` entries belong to them."""

    def __init__(self):
        self.n, self.ranges = 0, {}

    def add(self, f: int, block: int, n: int) -> None:
        self.n += n
        self.ranges[f] = (self.ranges.get(f, (block,))[0], block)

    def has(self, f: str, r: str) -> Column:
        """Condition on the columns of a file's hash and the row in it; the first half lets Spark leave files unread."""
        within = ((F.col(f) == x) & F.col(r).between(lo << BLOCK, ((hi + 1) << BLOCK) - 1) for x, (lo, hi) in self.ranges.items())
        return F.col(f).isin(list(self.ranges)) & reduce(lambda x, y: x | y, within)


def parts_of(entries: DataFrame, f: str, r: str, size: Column) -> list[Part]:
    """Parts with ``SMALL`` entries at most (unless a single block of rows has more) that hold all of ``entries``; a row counts ``size``."""
    found = [Part()]
    blocks = entries.groupBy(F.col(f), F.shiftright(r, BLOCK)).agg(F.sum(size))
    for file, block, n in sorted(map(tuple, blocks.collect())):  # one row for 16,384 rows of a file
        if found[-1].n and found[-1].n + n > SMALL:
            found.append(Part())
        found[-1].add(file, block, n)
    return [p for p in found if p.n]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has a link.

    ``edges`` has two bigint columns (a, b). The result has (node, root) for
    each node other than its component's smallest. Alternating large-star and
    small-star rounds until every component is a star; each round is written
    out, so no lineage grows and a lost executor costs one round at most. Group
    minima are partial aggregates, joined back on a unique side, so a hub of
    any degree stays splittable.
    """
    a, b = edges.columns
    e = stored(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "cc")
    for _ in range(max_rounds):
        ends = e.select(F.col("hi").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(e.select(F.col("lo").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        open_ = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1")
        if open_.isEmpty():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(low.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        nxt = stored(small.where("hi > lo").select("lo", "hi").distinct(), "cc")
        drop_scratch(e)
        e = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def by_bytes(batch, rows: int, most: int = 4 << 20, column: str = "text"):
    """``batch`` in slices of at most ``rows`` rows, and of ``most`` bytes of ``column`` unless a single row has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= rows or held + n > most):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(columns) -> list:
    """Columns by names that may hold dots or blanks."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]


def located(docs: DataFrame, *columns: str, marks: tuple[str, str] = ("_f", "_r")) -> DataFrame:
    """``columns`` of ``docs`` with the marks (file, row): hash of the file and row number in it.

    The pair names a row wherever and however often it is read, which an id
    that may repeat doesn't. Tables that aren't read straight from Parquet
    files are written to the shared folder first, and so is one with a column
    that hides the file's metadata.
    """
    mark = [F.xxhash64("_metadata.file_path").alias(marks[0]), F.col("_metadata.row_index").alias(marks[1])]
    hidden = {c: fresh(docs.columns, f"_{c}") for c in columns if c.lower() == "_metadata"}
    if not hidden and "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.select(*mark, *quoted(columns))
        except AnalysisException:
            pass
    kept = stored(docs.select(*quoted(columns)).withColumnsRenamed(hidden), "located")
    return kept.select(*mark, *quoted(kept.columns)).withColumnsRenamed({new: old for old, new in hidden.items()})
