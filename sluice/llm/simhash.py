"""SimHash near-duplicate classes by pigeonhole blocks.

1. Every text gets a 64-bit fingerprint (Arrow batches, numpy majority vote).
2. Equal fingerprints collapse to one row, whatever the number of copies.
3. The 64 bits are four blocks of 16. Fingerprints that differ in at most two
   bits agree in two whole blocks at least, so they share one of the six keys
   made of a pair of blocks.
4. Within a key, pairs are compared and kept at a Hamming distance of two or
   less. A key held by more than ``pair_limit`` fingerprints is split first:
   the other 32 bits are three sub-blocks of which a close pair shares one.
   What is still crowded then is linked through midpoints: two fingerprints
   are within two bits exactly when flipping at most one bit of each can make
   them equal, so each emits itself and its one-bit neighbours and links to the
   least of those it meets (a link that is itself verified). That is linear in
   the crowd and yields the same components as all pairs would.
5. Components of the links give each fingerprint, and so each row, its class.

Nulls and texts without a word have fingerprint 0 and link like any other.
Rows that repeat an id are returned as often as they occur. A class whose ids
are all null has a null component. An empty table gives an empty result. Extra
columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sluice.llm.common import bounded, connected_components, drop_scratch, fresh, located, marked_join, quoted, stored, table

SEED, SHINGLE, MAX_BITS, PAIR_LIMIT = 42, 3, 2, 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        spans = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        hashes = np.fromiter((digest(s, seed) for s in spans), np.uint64, len(words) - size + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, ..., fp): fp is the fingerprint's bits as a signed bigint."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text")
    kept = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fps.view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in kept), StructField("fp", LongType())]))


def _sized(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., members, a, b), stored: the keys with two members or more, and their least and greatest fingerprint."""
    return stored(rows.groupBy(*key).agg(F.count("*").alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("members > 1"), "simhash-keys")


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def _pairs(rows: DataFrame, key: list[str], max_bits: int) -> DataFrame:
    a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    return a.join(b, key).where((F.col("a") < F.col("b")) & _near(max_bits)).select("a", "b")


def links(fps: DataFrame, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``max_bits`` (at most 2); ``fps`` is distinct.

    Keys of two members are pairs as they are counted; only members of larger
    keys are looked up again, and the finer tiers are planned only if a key has
    over ``pair_limit`` members.
    """
    if max_bits > 2:
        raise ValueError("six keys of two blocks cover two differing bits at most")
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    couples = list(enumerate(combinations(range(4), 2)))
    others = lambda i, j: [x for x in range(4) if x not in (i, j)]
    held = fps.select("fp", F.explode(F.array(*(F.lit(k << 32) + F.shiftleft(block(i), 16) + block(j) for k, (i, j) in couples))).alias("key"))
    sizes = _sized(held, "key")
    found = [sizes.where("members = 2").where(_near(max_bits)).select("a", "b")]
    larger = stored(sizes.where("members > 2").select("key", "members"), "simhash-larger")
    crowd = stored(held.join(bounded(larger), "key"), "simhash-crowd")
    found.append(_pairs(crowd.where(F.col("members") <= pair_limit).select("key", "fp"), ["key"], max_bits))
    many = crowd.where(F.col("members") > pair_limit).select("key", "fp")
    if not many.isEmpty():
        couple = F.shiftright("key", 32)
        bit = lambda x, y: F.lit(1 << (16 * x + y) if 16 * x + y < 63 else -(1 << 63)).cast("bigint")
        of_couple = lambda make: F.coalesce(*(F.when(couple == k, make(*others(i, j))) for k, (i, j) in couples))
        rest = of_couple(lambda p, q: F.shiftleft(block(p), 16) + block(q))
        parts = [F.shiftleft(F.col("key"), 13) + F.lit(n << 11) + F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << width) - 1)) for n, (at, width) in enumerate(((0, 11), (11, 11), (22, 10)))]
        finer = stored(many.select(F.col("key").alias("coarse"), "fp", F.explode(F.array(*parts)).alias("key")), "simhash-finer")
        sized = _sized(finer, "key")
        found.append(sized.where("members = 2").where(_near(max_bits)).select("a", "b"))
        again = finer.join(sized.where("members > 2").select("key", "members"), "key")
        found.append(_pairs(again.where(F.col("members") <= pair_limit).select("key", "fp"), ["key"], max_bits))
        tight = again.where(F.col("members") > pair_limit).select(F.col("coarse").alias("key"), "fp").distinct()
        bits = of_couple(lambda p, q: F.array(*(bit(x, y) for x in (p, q) for y in range(16))))
        flips = F.transform(bits, lambda m: F.col("fp").bitwiseXOR(m))
        mids = tight.select("key", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("mid"))
        met = mids.groupBy("mid").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)  # at most 65: one bit from mid
        star = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        found.append(star.where((F.col("a") != F.col("b")) & _near(max_bits)))
    out = stored(reduce(DataFrame.unionAll, found).distinct(), "simhash-links")
    for t in (sizes, larger, crowd):
        drop_scratch(t)
    return out


def roots(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of the fingerprints that have a link, but for the roots themselves."""
    return connected_components(links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")


def classes(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = stored(with_fingerprint(docs), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = fps.join(roots(fps, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stored(rooted.join(ids, "root").select("fp", "component_id"), "simhash-class")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each class: of those with the smallest id the one with the longest text.

    Rows are named by file and row number, so rows that repeat an id are told
    apart: those of one class leave one row, those of two classes one each. A
    row without an id stays only if no row of its class has one. What is
    decided travels without texts; the rows that go are filtered out where the
    texts are read, by a broadcast of at most ``SMALL`` rows of 16 bytes, and
    by a join beyond.
    """
    f, r = (fresh(docs.columns, n) for n in ("_f", "_r"))
    whole = located(docs, *docs.columns, marks=(f, r))
    marked = whole.select("doc_id", F.col(f).alias("f"), F.col(r).alias("r"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")
    rows = stored(with_fingerprint(marked, "f", "r", "n"), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (-F.col("n")).alias("short"), "f", "r")).alias("best")
    fps = stored(rows.groupBy("fp").agg(best, F.count("*").alias("times")), "simhash-fps")
    rooted = fps.join(roots(fps, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    shared = rooted.groupBy("root").agg(F.min("best").alias("stays"), F.sum("times").alias("all")).where(F.col("all") > 1)
    stays = stored(rooted.join(shared, "root").select("fp", F.col("stays.f").alias("sf"), F.col("stays.r").alias("sr")), "simhash-stays")
    gone = rows.join(bounded(stays), "fp").where((F.col("f") != F.col("sf")) | (F.col("r") != F.col("sr")))
    gone = stored(gone.select(F.col("f").alias(f), F.col("r").alias(r)), "simhash-gone")
    for t in (rows, fps, stays):
        drop_scratch(t)
    return marked_join(whole, gone, (f, r), "left_anti").select(*quoted(docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
