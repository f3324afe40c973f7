"""Quality rules whose thresholds come from the corpus.

Every text is measured whole. For each language and source a mergeable
quantile sketch (KLL) of each ratio is built; sketches of sources merge into
those of languages and these into one of the corpus. A document fails if a
ratio lies beyond the fence of its group, third quartile plus ``REACH`` times
the quartile range (which is taken to be ``LEAST`` at least, so that a group of
equal documents has a fence too), or below the mirrored fence for mean word
length. Groups with under ``MIN_GROUP`` documents take their language's
thresholds, small languages the corpus's. Two fixed base rules come first.

Nulls: a null text has no words and fails the base rule; null language or
source form groups of their own. Repeated rows count and are returned as often
as they occur. Texts without a word enter no sketch. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import stored, table

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
REACH, MIN_GROUP, SKETCH_K, SMALL_GROUPS = 4.0, 200, 400, 10_000
#: The least quartile range of each ratio.
LEAST = {"symbols": 0.02, "upper": 0.03, "marks": 0.02, "dup_lines": 0.08, "repeats": 0.1, "word_length": 0.5}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_letters", "n_upper", "n_marks")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = n[at] > 1
    if not hit.any():
        return 0
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """Values of COUNTS and EXTRA for a text."""
    if not text:
        return (0,) * (len(COUNTS) + len(EXTRA))
    data = text.encode("utf-8", "surrogatepass")
    words, seen, dups, lines = data.split(), set(), 0, 0
    for line in data.split(b"\n"):
        if line in seen:
            dups += 1
            lines += 1
        elif line and not line.isspace():
            seen.add(line)
            lines += 1
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    marks = int(c[33:127].sum()) - upper - lower - digits
    chars = len(text) - sum(map(text.count, BLANKS))
    accents = len(text) - int(c[:128].sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeat_words(words), lines, upper + lower + accents, upper, marks


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts...) for every row."""
    names = COUNTS + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column("text")]
            cols = np.array(rows, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(c) for c in cols)], ["doc_id", "lang", "source", *names])

    kinds = ", ".join(f"{n} bigint" for n in names)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, f"doc_id bigint, lang string, source string, {kinds}")


def with_ratios(rows: DataFrame) -> DataFrame:
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    parts = {"symbols": ("n_symbols", "n_words"), "upper": ("n_upper", "n_letters"), "marks": ("n_marks", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    return rows.withColumns({k: over(*v) for k, v in parts.items()})


def thresholds(rows: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <ratio>_hi..., word_length_lo), one row for each group of ``rows``."""
    sketches = stored(rows.groupBy("lang", "source").agg(F.count("n_words").alias("n"), *(F.kll_sketch_agg_double(F.coalesce(m, F.lit(0.0)), F.lit(SKETCH_K)).alias(m) for m in LEAST)), "quality-sketch")
    merge = lambda d: [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in LEAST)]
    by_lang, whole = sketches.groupBy("lang").agg(*merge(sketches)), sketches.agg(*merge(sketches))
    total = whole.select(*(F.col(m).alias(f"all_{m}") for m in LEAST)).first()
    langs = by_lang.select(F.col("lang").alias("l"), F.col("n").alias("lang_n"), *(F.col(m).alias(f"lang_{m}") for m in LEAST))
    joined = sketches.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left")
    out = []
    for m, least in LEAST.items():
        all_m = total[f"all_{m}"]
        pick = F.when(F.col("n") >= min_group, F.col(m)).when(F.col("lang_n") >= min_group, F.col(f"lang_{m}")).otherwise(F.lit(bytes(all_m) if all_m is not None else None))
        q1, q3 = (F.kll_sketch_get_quantile_double(pick, F.lit(q)) for q in (0.25, 0.75))
        width = F.greatest(q3 - q1, F.lit(least))
        out.append((q3 + reach * width).alias(f"{m}_hi"))
        if m == "word_length":
            out.append((q1 - reach * width).alias(f"{m}_lo"))
    return joined.select("lang", "source", *out)


def judged(docs: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, ratios, base_failed and kept for every row of ``docs``."""
    rows = with_ratios(stored(measured(docs), "quality"))
    limits = stored(thresholds(rows.where("n_words > 0"), reach, min_group), "quality-limits").withColumnsRenamed({"lang": "l", "source": "s"})
    if limits.count() <= SMALL_GROUPS:
        limits = F.broadcast(limits)
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = reduce(or_, [F.coalesce(F.col(m) > F.col(f"{m}_hi"), F.lit(False)) for m in LEAST] + [F.coalesce(F.col("word_length") < F.col("word_length_lo"), F.lit(False))])
    return both.select("doc_id", "lang", "source", *COUNTS, *LEAST, base.alias("base_failed"), (~base & ~beyond).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
