"""Language-model scores by context-tree weighting over bytes.

Model. A byte is coded as eight binary decisions, one for each node of its
binary tree; every decision has a context tree over the preceding ``DEPTH``
bytes. A node of that tree holds how often either bit followed its context in
the training texts, the Krichevsky-Trofimov estimate of those counts, and the
weighted probability that mixes its own estimate with the product of its
children's, down all depths. A text's probability is the product of the mixed
predictions for its bytes and for the byte 0 that ends it; at the start the
context is zeros.

Work. Rows are numbered within their file and cut into blocks of
``BLOCK_ROWS``. Every block sends its distinct tokens and its distinct
(context, byte) strings with their training counts: far fewer rows than
positions, and a token occurs at most once for each block, so no key is hot.
Summed over the corpus these give the exact counts. Contexts are evaluated in
groups that share the last two bytes, of which there are 65,536 at most, each
with bounded content; only the two shallowest levels (65,280 + 255 nodes at
most, whatever the corpus) meet on the driver. Each block then gets back the
values of its own tokens and strings and scores its texts with them.

Nulls: a null text is the empty text, whose only token is the end. A null id
is a training row. Repeated rows count and are scored as often as they occur.
Without training rows every estimate is even odds. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import drop_scratch, stored, table
from sluice.llm.langid import held_out

DEPTH, BLOCK_ROWS, CHUNK = 4, 5000, 1 << 19
END = b" "  # no word holds a blank
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return data, data.split()


def strings_of(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """(context, byte) of every position of every text, end included, as integers of depth + 1 bytes."""
    pad = b"\0" * depth
    x = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    g = np.zeros(len(x) - depth, np.int64)
    for j in range(depth + 1):
        g = (g << 8) | x[j : len(x) - depth + j]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    keep = np.ones(len(g), bool)  # position i stands for the byte at i + depth
    for j in range(1, depth + 1):
        keep[starts[1:] - j] = False
    return g[keep]


class Tally:
    """Distinct strings and their counts, merged chunk by chunk."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[bytes], train: bool, depth: int) -> None:
        if texts:
            k, n = np.unique(strings_of(texts, depth), return_counts=True)
            self.merge(k, n if train else np.zeros(len(k), np.int64))

    def merge(self, k: np.ndarray, n: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(keys)).astype(np.int64)
        self.keys = keys


ITEMS = pa.schema([("block", pa.string()), ("token", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def count_blocks(rows: DataFrame, depth: int) -> DataFrame:
    """Distinct tokens and strings of each block with their counts in its training texts."""

    def emit(block, tokens, others, tally) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        names = [*tokens, *(t for t in others if t not in tokens)]
        counts = [tokens.get(t, 0) for t in names]
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part)), pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array(counts[at : at + 50_000], pa.int64())], schema=ITEMS)
        for at in range(0, len(tally.keys), 50_000):
            k = tally.keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(k)), pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(tally.n[at : at + 50_000])], schema=ITEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens, others, tally, texts, size = None, Counter(), set(), Tally(), ([], []), 0
        for b in batches:
            for name, text, out in zip(b.column("block").to_pylist(), b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                if name != block or size > CHUNK:
                    for part, train in zip(texts, (True, False), strict=True):
                        tally.add(part, train, depth)
                    texts, size = ([], []), 0
                if name != block:
                    if block is not None:
                        yield from emit(block, tokens, others, tally)
                    block, tokens, others, tally = name, Counter(), set(), Tally()
                data, words = words_of(text)
                (others.update if out else tokens.update)(words)
                (others.update if out else tokens.update)([END])
                texts[bool(out)].append(data)
                size += len(data)
        for part, train in zip(texts, (True, False), strict=True):
            tally.add(part, train, depth)
        if block is not None:
            yield from emit(block, tokens, others, tally)

    return rows.select("block", "text", "held_out").mapInArrow(run, "block string, token binary, gram bigint, n bigint")


class Levels:
    """Counts and weighted probabilities of the nodes of one group, from its strings, for depths 2..depth."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        x = grams & 255
        bits = np.arange(8)
        node = (1 << bits) | (x[:, None] >> (8 - bits))
        self.bit = (x[:, None] >> (7 - bits)) & 1
        above = grams >> 24  # the bytes before the last two, nearest in the lowest place
        key = (((above[:, None]) << 8) | node).ravel()
        keys, at = np.unique(key, return_inverse=True)
        w, ones = np.repeat(n, 8).astype(float), self.bit.ravel() == 1
        zero, one = np.bincount(at, w * ~ones, len(keys)), np.bincount(at, w * ones, len(keys))
        self.at, self.levels = [at], []
        down = None
        for d in range(depth, 1, -1):
            own = kt(zero, one)
            lw = own if down is None else np.logaddexp(HALF + own, HALF + down)
            self.levels.append((zero, one, own, lw))
            if d > 2:
                up = ((keys >> 8) & ((1 << 8 * (d - 3)) - 1)) << 8 | (keys & 255)
                keys, to = np.unique(up, return_inverse=True)
                zero, one, down = (np.bincount(to, v, len(keys)) for v in (zero, one, lw))
                self.at.append(to)
        self.nodes = keys & 255

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        zero, one, _, lw = self.levels[-1]
        return self.nodes, zero, one, lw

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Mixed probability of a one for each string and bit at depth 2, and the node of each."""
        zero, one, _, _ = self.levels[0]
        p, at = ((one + 0.5) / (zero + one + 1))[self.at[0]], self.at[0]
        for (zero, one, own, lw), to in zip(self.levels[1:], self.at[1:], strict=True):
            at = to[at]
            p = mixed(zero, one, own, lw, at, p)
        return p.reshape(-1, 8), self.nodes[at].reshape(-1, 8)


def mixed(zero, one, own, lw, at, deeper) -> np.ndarray:
    stop = np.exp(HALF + own - lw)[at]
    return stop * ((one + 0.5) / (zero + one + 1))[at] + (1 - stop) * deeper


def shallow(up: pd.DataFrame) -> dict[int, tuple]:
    """Levels 1 (index last byte * 256 + node) and 0 (index node) from the sums of level 2."""
    at = (up["last"] * 256 + up["node"]).to_numpy(np.int64)
    out, lows = {}, [np.bincount(at, up[c].to_numpy(float), 65536).astype(float) for c in ("zero", "one", "lw")]
    for d in (1, 0):
        zero, one, down = lows
        own = kt(zero, one)
        lw = np.logaddexp(HALF + own, HALF + down)
        out[d] = (zero, one, own, lw)
        lows = [v.reshape(-1, 256).sum(axis=0) for v in (zero, one, lw)]
    return out


def string_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, lp): log10 probability of the last byte after the others."""
    spark = counts.sparkSession
    groups = counts.withColumn("tail", F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int"))

    def rise(key, t):
        lv = Levels(t["gram"].to_numpy(), t["n"].to_numpy(), depth)
        node, zero, one, lw = lv.top()
        return pa.table({"last": pa.array(np.full(len(node), key[0].as_py() & 255), pa.int64()), "node": pa.array(node.astype(np.int64)), "zero": zero, "one": one, "lw": lw})

    up = groups.groupBy("tail").applyInArrow(rise, "last bigint, node bigint, zero double, one double, lw double")
    sums = up.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "lw"))).toPandas()  # 65,280 rows at most
    low = spark.sparkContext.broadcast(shallow(sums))

    def fall(key, t):
        grams = t["gram"].to_numpy()
        lv = Levels(grams, t["n"].to_numpy(), depth)
        p, node = lv.predict()
        p = mixed(*low.value[1], node + 256 * (key[0].as_py() & 255), p)
        p = mixed(*low.value[0], node, p)
        return pa.table({"gram": pa.array(grams), "lp": np.log10(np.where(lv.bit == 1, p, 1 - p)).sum(axis=1)})

    return groups.groupBy("tail").applyInArrow(fall, "gram bigint, lp double")


def score(docs: DataFrame, depth: int = DEPTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    ``docs`` has to come from files (its rows are numbered by file); other
    tables are written to the shared folder first.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        docs = stored(docs.select("doc_id", "text"), "lm-docs")
    block = F.concat_ws(":", F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / block_rows))
    rows = docs.select(block.alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(of=7).alias("held_out"))
    items = stored(count_blocks(rows, depth), "lm-items")
    by_token = Window.partitionBy("token")
    tokens = items.where("token IS NOT NULL").select("block", "token", F.sum("n").over(by_token).alias("c"), (F.row_number().over(by_token.orderBy("block")) == 1).alias("first"))
    tokens = stored(tokens, "lm-tokens")
    n, v = tokens.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    grams = items.where("gram IS NOT NULL")
    counts = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "lm-counts")
    scores = stored(string_scores(counts, depth), "lm-scores")
    drop_scratch(counts)
    values = tokens.select("block", "token", F.lit(None).cast("bigint").alias("gram"), F.log10(F.col("c") + 1).alias("value")).unionAll(grams.select("block", "gram").join(scores, "gram").select("block", F.lit(None).cast("binary").alias("token"), "gram", F.col("lp").alias("value")))

    def evaluate(docs, values):
        is_token = values["token"].is_valid()
        own = values.filter(is_token)
        known = dict(zip(own["token"].to_pylist(), own["value"].to_pylist(), strict=True))
        own = values.filter(values["gram"].is_valid())
        keys, first = np.unique(own["gram"].to_numpy(), return_index=True)
        lps = own["value"].to_numpy()[first]
        del own, values
        ids, out = docs["doc_id"], {k: [] for k in ("n_tokens", "n_known", "logs", "score", "bytes")}
        texts, size = [], 0

        def flush() -> None:
            if texts:
                lp = lps[np.searchsorted(keys, strings_of(texts, depth))]
                starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
                out["score"].append(np.add.reduceat(lp, starts))

        for text in docs["text"]:
            data, words = words_of(text.as_py())
            words.append(END)
            logs = np.fromiter(map(known.__getitem__, words), float, len(words))
            for k, x in (("n_tokens", len(words)), ("n_known", int(np.count_nonzero(logs))), ("logs", float(logs.sum())), ("bytes", len(data))):
                out[k].append(x)
            texts.append(data)
            size += len(data)
            if size > CHUNK:
                flush()
                texts, size = [], 0
        flush()
        known.clear()
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": ids, "held_out": docs["held_out"], "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "logs": pa.array(out["logs"], pa.float64()), "score": np.concatenate(out["score"]) if out["score"] else np.zeros(0), "bytes": pa.array(out["bytes"], pa.int64())})

    made = rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(evaluate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, bytes bigint")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base and context-tree score of every document."""
    return score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
