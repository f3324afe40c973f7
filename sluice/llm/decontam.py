"""Benchmark decontamination by latent semantic retrieval.

1. Terms: every word of the benchmark items has a column of its own, all other
   words share ``HASHED`` columns. Texts are cut into steps of ``STEP`` words;
   two neighbouring steps are a passage. Document frequencies are counted over
   all steps of all texts.
2. Distributed randomised SVD of the TF-IDF passages: tasks multiply their
   passages by a random test matrix and send sums of fixed size, a second pass
   sharpens the basis. It is fitted on the items and the passages of about
   ``SAMPLE_DOCS`` documents, chosen by a hash of the text; that bound is on
   the index only, every passage of every text is searched.
3. Every passage is projected; items whose cosine with it is ``MIN_COSINE`` or
   more are candidates.
4. A candidate is checked on its words and those around it: it holds if the
   longest common subsequence covers ``MIN_LCS`` of the item, or ``MIN_PART``
   of it and the item's answer (its last words) stands there word for word.
   Items under ``SHORT`` words have to occur word for word.

The items are the query set; more than ``ITEM_BLOCK`` of them are searched
block by block, each with a basis of its own. A block has no more items than
the basis has columns, so that it holds nearly all of every item's length: what
it lost would lower all of the item's cosines. Work grows with the blocks.

Nulls: a null text or item holds nothing; items without a word are ignored; a
null id stays null in the result. Rows that repeat are reported as often as
they occur, items with equal text each under their own id. Empty tables give
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import by_bytes, table

STEP, HASHED, RANK, SAMPLE_DOCS, ITEM_BLOCK, PARTS, KEPT = 24, 4096, 256, 2000, 256, 8, 50_000
MIN_COSINE, MIN_LCS, MIN_PART, SHORT, ANSWER = 0.2, 0.7, 0.5, 8, 5
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; every byte over 127 counts as a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class TermIds(dict):
    """Column of a word; words that are no item's word are hashed (and ``KEPT`` of them remembered)."""

    def __init__(self, words: list[bytes], hashed: int = HASHED):
        super().__init__((w, i) for i, w in enumerate(words))
        self.own, self.hashed = len(self), hashed

    def __missing__(self, w: bytes) -> int:
        i = self.own + zlib.crc32(w) % self.hashed
        if len(self) < self.own + KEPT:
            self[w] = i
        return i

    def __reduce__(self):
        return TermIds, (sorted((w for w, i in self.items() if i < self.own), key=self.get), self.hashed)

    @property
    def size(self) -> int:
        return self.own + self.hashed


def steps_of(n: int) -> int:
    """Number of steps of a text of n words; the last may be short."""
    return -(-n // STEP)


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        if y := v & masks.get(w, 0):
            v = (v + y | v - y) & full
    return len(item) - v.bit_count()


def contains(words: list[bytes], part: list[bytes]) -> bool:
    return b" " + b" ".join(part) + b" " in b" " + b" ".join(words) + b" "


@dataclass
class Index:
    ids: TermIds
    item_ids: list
    items: list[list[bytes]]
    idf: np.ndarray
    basis: np.ndarray | None = None
    near: np.ndarray | None = field(default=None, repr=False)
    square: np.ndarray | None = field(default=None, repr=False)
    bags: list[Counter] = field(default_factory=list, repr=False)

    def columns(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def ready(self) -> Index:
        """With the basis set: products of each projected term (and a row of zeros that fills up steps) with each projected item over its length."""
        zero = np.zeros((1, self.basis.shape[1]))
        lifted = np.vstack([self.idf[:, None] * self.basis, zero]).astype(np.float32)
        self.square = np.append(self.idf**2, 0.0).astype(np.float32)
        rows = [(lifted[c].sum(axis=0), self.square[c].sum()) for c in map(self.columns, self.items)]
        self.near = lifted @ np.array([q / np.sqrt(max(sq, 1e-12)) for q, sq in rows], np.float32).T
        self.basis = None  # the table holds it
        self.bags = [Counter(w) for w in self.items]
        return self

    def candidates(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, float]]:
        """(text, first word, end, item, cosine) for passages near an item."""
        counts = [steps_of(len(w)) for w in texts]
        total = sum(counts)
        if not total:
            return []
        at, owner, first, done = np.full(total * STEP, len(self.idf), np.int64), np.repeat(np.arange(len(texts)), counts), np.zeros(total, np.int64), 0
        for words, n in zip(texts, counts, strict=True):
            at[done * STEP : done * STEP + len(words)] = self.columns(words)
            first[done : done + n] = np.arange(n) * STEP
            done += n
        at = at.reshape(-1, STEP)
        found = []
        for a in range(0, total, 4096):  # passages that begin at the steps a .. b
            b = min(total, a + 4096)
            part = at[a : min(total, b + 1)]
            p, sq = self.near[part[:, 0]], self.square[part].sum(axis=1)
            for j in range(1, STEP):
                p += self.near[part[:, j]]
            own = owner[a : a + len(part)]
            paired = own[:-1] == own[1:]
            p[:-1] += np.where(paired[:, None], p[1:], 0)
            sq[:-1] += np.where(paired, sq[1:], 0)
            alone = np.append(paired, False) | (first[a : a + len(part)] == 0)  # the last step is in the passage before it
            cos = p / np.sqrt(np.maximum(sq, 1e-12))[:, None]
            for r, item in np.argwhere((cos >= MIN_COSINE) & alone[:, None]):
                if r < b - a:
                    f = int(first[a + r])
                    found.append((int(owner[a + r]), f, f + 2 * STEP, int(item), float(cos[r, item])))
        return found

    def hits(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float, bool]]:
        """(text, item, cosine, share of the item in the common subsequence, answer found), the best of each text and item."""
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for t, first, end, k, cos in self.candidates(texts):
            item = self.items[k]
            near = texts[t][max(0, first - len(item)) : end + len(item)]
            if len(item) < SHORT:
                ok = contains(near, item)
                share, answer = float(ok), ok
            else:
                if sum(self.bags[k][w] for w in self.bags[k].keys() & near) < MIN_PART * len(item):
                    continue  # no subsequence can be long enough
                share = lcs(item, near) / len(item)
                answer = share >= MIN_PART and contains(near, item[-ANSWER:])
                ok = share >= MIN_LCS or answer
            if ok and (share, cos, answer) > best.get((t, k), (-1.0, 0.0, False)):
                best[t, k] = (share, cos, answer)
        return [(t, k, cos, share, answer) for (t, k), (share, cos, answer) in sorted(best.items())]


def _batches(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return by_bytes(b, rows, 1 << 20)


def frequencies(docs: DataFrame, ids: TermIds) -> tuple[np.ndarray, int]:
    """Number of steps each column occurs in, and of all steps."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, df, total, seen = shared.value, np.zeros(shared.value.size, np.int64), 0, Counter()

        def fold() -> None:
            np.add.at(df, np.fromiter((ids[w] for w in seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for b in batches:
            for text in b.column("text"):
                words = words_of(text.as_py())
                for at in range(0, len(words), STEP):
                    seen.update(set(words[at : at + STEP]))
                total += steps_of(len(words))
                if len(seen) > KEPT:
                    fold()
        fold()
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(held, -1)), "n": pa.array(np.append(df[held], total))})

    got = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # ids.size + 1 rows at most
    shared.destroy()
    df, term, n = np.zeros(ids.size, np.int64), got["term"].to_numpy(), got["n"].to_numpy()
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term == -1].sum())


def _product(sample: DataFrame, index: Index, right: np.ndarray) -> np.ndarray:
    """A^T A right for the sample's passages, summed over tasks in chunks of rows."""
    sc, k, rows = sample.sparkSession.sparkContext, right.shape[1], 512
    shared = sc.broadcast((index, right.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, right = shared.value
        out = np.zeros_like(right)
        for whole in batches:
            for b in _batches(whole):
                for text in b.column("text"):
                    words = words_of(text.as_py())
                    c = index.columns(words)
                    for s in range(0, len(c), 2 * STEP):
                        t, n = np.unique(c[s : s + 2 * STEP], return_counts=True)
                        w = n * index.idf[t]
                        w = (w / np.sqrt(max(float(w @ w), 1e-12))).astype(np.float32)
                        out[t] += w[:, None] * (w @ right[t])
        for at in range(0, len(out), rows):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "part": pa.array([out[at : at + rows].tobytes()], pa.binary())})

    def add(key, t):
        total = sum(np.frombuffer(p.as_py(), np.float32).astype(np.float64) for p in t["part"])
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = sample.mapInArrow(run, "at bigint, part binary").groupBy("at").applyInArrow(add, "at bigint, part binary").toArrow()  # one matrix
    shared.destroy()
    out = np.zeros(right.shape)
    for at, part in zip(parts["at"].to_pylist(), parts["part"], strict=True):
        out[at : at + rows] = np.frombuffer(part.as_buffer()).reshape(-1, k)
    return out


def build(docs: DataFrame, items: list[tuple], rank: int = RANK, sample_docs: int = SAMPLE_DOCS, seed: int = 17) -> Index | None:
    """Index for the items (id, text)."""
    rows = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
    if not rows:
        return None
    ids = TermIds(sorted({w for _, ws in rows for w in ws}))
    df, total = frequencies(docs, ids)
    idf = np.log((total + 1) / (df + 1)) + 0.05
    index = Index(ids, [i for i, _ in rows], [w for _, w in rows], idf)
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where("text IS NOT NULL").where(draw < share).select("text").repartition(PARTS).persist()
    q = np.zeros((len(rows), ids.size))
    for i, (_, ws) in enumerate(rows):
        t, n = np.unique(index.columns(ws), return_counts=True)
        q[i, t] = n * idf[t]
    q /= np.sqrt((q**2).sum(axis=1, keepdims=True))
    k = min(rank, ids.size)
    weight = max(1.0, sample_docs * 10.0 / len(rows))  # about as much as the sample's passages
    right = np.random.default_rng(seed).normal(size=(ids.size, k))
    for _ in range(2):
        b = _product(sample, index, right) + weight * (q.T @ (q @ right))
        right, _ = np.linalg.qr(b)
    index.basis = right
    sample.unpersist()
    return index.ready()


def item_blocks(benchmark: DataFrame, size: int = ITEM_BLOCK) -> list[list[tuple]]:
    """The query set in blocks; read through a local iterator, so one block at a time is held."""
    rows, blocks = [], []
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == size:
            blocks.append(rows)
            rows = []
    return [*blocks, rows] if rows else blocks


def search(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found), one row for each document and item it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for b in _batches(whole):
                ids = b.column("doc_id").to_pylist()
                got = index.hits([words_of(t.as_py()) for t in b.column("text")])
                if got:
                    t, k, cos, share, answer = zip(*got, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[x] for x in t], pa.int64()), "item_id": pa.array([index.item_ids[x] for x in k], pa.int64()), "cosine": pa.array(cos), "lcs_share": pa.array(share), "answer_found": pa.array(answer)})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits of all items in all documents."""
    found = None
    for items in item_blocks(benchmark):
        if (index := build(docs, items)) is not None:
            part = search(docs, index)
            found = part if found is None else found.unionAll(part)
    empty = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean"
    return found if found is not None else docs.sparkSession.createDataFrame([], empty)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no item; filtered where they are read, without a join."""
    texts = docs.select("text")
    for items in item_blocks(benchmark):
        index = build(texts, items)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in _batches(whole):
                    bad = {h[0] for h in shared.value.hits([words_of(t.as_py()) for t in b.column("text")])}
                    yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
