"""Language identification with the byte convolutional network.

The network learns from windows of a bounded sample of labelled texts:
about ``PER_LANG`` different texts of each language, those with the least hashes, and
``WINDOWS`` windows of each, placed by hashes of the text. Only text and label enter. Every text is then
predicted whole: all its windows of ``LENGTH`` bytes are classified and their
probabilities averaged, weighted by the letters in each window.

Nulls and texts without a letter give ``und`` with score 0. Rows whose label
is null teach nothing. Without any label every row is ``und``. Rows that repeat
are predicted as often as they occur. Extra columns are ignored. More than
``MAX_LANGS`` labels is an error, so that the sample stays bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sluice.llm.common import by_bytes, fresh, table
from sluice.llm.convnet import ByteConvNet, softmax, windows_of

LENGTH, PER_LANG, WINDOWS, MAX_LANGS = 128, 1200, 4, 1000
LETTER = re.compile(r"[^\W\d_]")  # takes in numbers such as one half, which are no letters
IS_LETTER = np.array([(65 <= c <= 90) or (97 <= c <= 122) or c >= 0xC3 for c in range(256)])


def held_out(doc_id: Column = None, of: int = 4) -> Column:
    """crc32(doc_id as text) mod ``of`` is 2; a null id is never held out."""
    c = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % of == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Model:
    labels: list[str]
    net: ByteConvNet | None
    length: int = LENGTH

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(label, score) for each text; all windows of all texts go through the network together."""
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if self.net is None:
            return found
        parts, owner = [], []
        for i, t in enumerate(texts):
            if t and has_letter(t):
                parts.append(windows_of(t.lower().encode("utf-8", "replace"), self.length))
                owner.append((i, len(parts[-1])))
        if not parts:
            return found
        x = np.vstack(parts)
        prob = softmax(self.net.logits(x)) * (IS_LETTER[x].sum(axis=1, keepdims=True) + 1e-6)
        starts = np.cumsum([0] + [n for _, n in owner[:-1]])
        mean = np.add.reduceat(prob, starts, axis=0)
        mean /= mean.sum(axis=1, keepdims=True)
        for (i, _), k, p in zip(owner, mean.argmax(axis=1), mean.max(axis=1), strict=True):
            found[i] = (self.labels[k], min(1.0, float(p)))
        return found


def train(labelled: DataFrame, per_lang: int = PER_LANG, length: int = LENGTH, seed: int = 11) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang)."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels")
    if not counts:
        return Model([], None, length)
    labels = sorted(counts)
    own = F.xxhash64("text", F.lit(seed))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n)))), F.col("lang"))
    sample = rows.where(F.pmod(own, F.lit(1_000_000)) / 1e6 < share)
    spot = lambda k: F.substr("text", (F.pmod(F.xxhash64("text", F.lit(seed + k)), F.greatest(F.lit(1), F.length("text") - length)) + 1).cast("int"), F.lit(length))
    once = sample.select("lang", own.alias("own"), F.array(*(spot(k) for k in range(1, WINDOWS + 1))).alias("w")).groupBy("lang", "own").agg(F.first("w").alias("w"))  # a group of equal texts teaches once
    got = once.orderBy("own", "lang").limit(2 * per_lang * len(labels)).toArrow()
    x, y = [], []
    for lang, parts in zip(got["lang"].to_pylist(), got["w"].to_pylist(), strict=True):
        for part in parts:
            if has_letter(part):
                x.append(windows_of(part.lower().encode("utf-8", "replace")[:length], length)[0])
                y.append(labels.index(lang))
    if not x:
        return Model([], None, length)
    return Model(labels, ByteConvNet(len(labels)).fit(np.array(x), np.array(y)), length)


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` added; columns of these names are replaced."""
    docs = docs.drop(pred, score)
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in by_bytes(whole, 400):
                got = m.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Rows whose language is recognised with ``min_score`` or more; columns of ``docs`` only."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    return identify(docs, model, pred, score).where((F.col(pred) != "und") & (F.col(score) >= min_score)).select(docs.columns)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
