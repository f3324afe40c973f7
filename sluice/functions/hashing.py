"""64-bit hashes in wrapping arithmetic, and salted tokens.

Spark 4 checks integer overflow, and decides about it where an expression is
built. ``wrapping`` builds with the check off and puts the setting back; the
columns then keep working whatever the setting is when they run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published constants of FNV-1(a) and of the SplitMix64 finaliser.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Within: added columns use wrapping arithmetic. Analyse them (with_column) before it ends."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _long(x: int) -> Column:
    return F.lit(signed(x)).cast("bigint")


def _bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as an array of bigint."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("bigint"))


def fnv1a64(text: Column) -> Column:
    return F.aggregate(_bytes(text), _long(FNV_BASIS), lambda h, b: h.bitwiseXOR(b) * _long(FNV_PRIME))


def fnv1_64(text: Column) -> Column:
    """FNV-1; zero is replaced, so that strides made of it never stand still."""
    h = F.aggregate(_bytes(text), _long(FNV_BASIS), lambda h, b: (h * _long(FNV_PRIME)).bitwiseXOR(b))
    return F.when(h == 0, _long(GOLDEN)).otherwise(h)


def mix64(h: Column) -> Column:
    """SplitMix64's finaliser."""
    a = h.bitwiseXOR(F.shiftrightunsigned(h, 30)) * _long(MIX_1)
    b = a.bitwiseXOR(F.shiftrightunsigned(a, 27)) * _long(MIX_2)
    return b.bitwiseXOR(F.shiftrightunsigned(b, 31))


def unsigned_mod(h: Column, n: int) -> Column:
    """h mod n for h read as unsigned."""
    return ((F.shiftrightunsigned(h, 1) % n) * 2 + h.bitwiseAND(F.lit(1))) % n


def with_roll(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with the sampling hash of ``text``: the same text gives the same number always."""
    with wrapping(df.sparkSession):
        hashed = df.withColumn(name, fnv1a64(F.coalesce(text, F.lit(""))))
        return hashed.withColumn(name, mix64(F.col(name)))


def token(value: Column, salt: str) -> Column:
    """Salted pseudonym of a value."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(salt + "\0"), value), 256), 1, 16))
