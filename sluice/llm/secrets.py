"""Secret scan: fixed patterns plus a byte convolutional network.

Patterns give the base findings. The network sees every other candidate (a run
of 16 or more token characters) of every whole text, with the characters
before and behind it. A candidate longer than ``BODY`` characters is seen in
overlapping pieces of that length, and its highest score counts. It is trained
on the labelled windows of all documents, equal texts once: every base finding
and ``PLANTED`` random keys, put into the places of words of each text, are
positive, every piece of every candidate is negative. The windows lie in blocks
of about ``BLOCK``, by hashes of the texts. A network fitted on one block is
where training begins; in each of ``ROUNDS`` rounds every block goes on from the
network of the round before with all its windows, and the mean of the blocks'
networks, weighted by windows, is the next. The windows of a fifth of the texts are
set aside: on all of them the scores are calibrated (Platt) and the threshold is the highest that
still recalls ``RECALL`` of the positives, both on margins rounded down to
1/``GRID``; the share of positives among what it takes is the model's
``precision``. Candidates at or over it become ``cnn``
spans; base findings always stay. With ``sample_docs`` a caller may train on
that many documents instead; the query doesn't.

A null text is read as empty. Repeated rows are scanned as often as they
occur. Without a candidate to learn from there is no network and only base
findings are returned. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import by_bytes, drop_scratch, stored, table
from sluice.llm.convnet import ByteConvNet

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("pass", "secret", "token", "api")
BEFORE, BODY, LENGTH = 16, 40, 64
RECALL, PLANTED, BLOCK, ROUNDS, STEPS, GRID = 0.95, 4, 100_000, 2, 400, 512


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then in the order of KINDS.

    Access keys and hex runs consist of token characters, so they are looked
    for only inside runs of those.
    """
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for t in TOKEN.finditer(text):
        s, e = t.span()
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, s, e) if m.end() - m.start() >= 16]
        if e - s >= 32:
            found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, s, e)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token runs that no base finding overlaps."""
    out, i = [], 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while i < len(base) and base[i][1] <= s:
            i += 1
        if not any(b[0] < e and b[1] > s for b in base[i:]):
            out.append((s, e))
    return out


def window(text: str, s: int, e: int, body: str | None = None) -> bytes:
    """The candidate's first characters and its surroundings as LENGTH bytes."""
    body = text[s:e] if body is None else body
    raw = text[max(0, s - BEFORE) : s].rjust(BEFORE) + "\x02" + body[:BODY] + "\x03" + text[e : e + LENGTH]
    return raw.encode("latin-1", "replace")[:LENGTH].ljust(LENGTH)


def pieces_of(s: int, e: int) -> list[tuple[int, int]]:
    """The candidate in pieces of BODY characters that overlap by half; the last ends with it."""
    if e - s <= BODY:
        return [(s, e)]
    return [(at, at + BODY) for at in [*range(s, e - BODY, BODY // 2), e - BODY]]


def random_key(rng: np.random.Generator) -> str:
    """A key as services issue them: hex, base32, base62 or base64, some with a prefix."""
    sets = (string.hexdigits[:16], string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
    alphabet = np.array(list(sets[rng.integers(len(sets))]))
    key = "".join(alphabet[rng.integers(0, len(alphabet), rng.integers(20, 44))])
    return ("", "", "sk_live_", "ghp_", "xoxb-", "pk-")[rng.integers(6)] + key


@dataclass
class Model:
    net: ByteConvNet
    slope: float
    shift: float
    threshold: float
    precision: float

    def scores(self, windows: list[bytes]) -> np.ndarray:
        z = self.net.logits(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH))
        return platt(z[:, 1] - z[:, 0], self.slope, self.shift)


def platt(margin: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 500, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins; ``n`` says how often each occurs."""
    slope, shift = 1.0, 0.0
    share = np.full(len(y), 1 / len(y)) if n is None else n / n.sum()
    for _ in range(steps):
        g = (platt(margin, slope, shift) - y) * share
        slope -= 0.05 * float((g * margin).sum())
        shift -= 0.05 * float(g.sum())
    return slope, shift


def threshold_for(scores: np.ndarray, y: np.ndarray, recall: float, n: np.ndarray | None = None) -> float:
    """The highest threshold at which ``recall`` of the positives are at or over it; ``n`` says how often each score occurs."""
    n = np.ones(len(y), np.int64) if n is None else n
    order = np.argsort(-scores[y == 1], kind="stable")
    held = np.cumsum(n[y == 1][order])
    return float(scores[y == 1][order][np.searchsorted(held, max(1, int(np.ceil(recall * held[-1]))))])


def labelled(text: str) -> Iterator[tuple[bytes, int]]:
    """(window, label) of every base finding, every candidate and the planted keys of a text."""
    base = base_findings(text)
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()))
    for s, e, _ in base:
        yield window(text, s, e), 1
    for c in candidates(text, base):
        for piece in pieces_of(*c):
            yield window(text, *piece), 0
    words = [m.span() for m in re.finditer(r"[A-Za-z]{5,}", text)]
    for k in rng.choice(len(words), min(PLANTED, len(words)), replace=False) if words else ():
        yield window(text, *words[k], body=random_key(rng)), 1


def windows(docs: DataFrame, seed: int) -> DataFrame:
    """(own, k, w, y), stored: the labelled windows of all texts; ``own`` is the text's hash, and equal texts are there once."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            own, k, w, y = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"own": pa.array(own, pa.int64()), "k": pa.array(k, pa.int32()), "w": pa.array(w, pa.binary()), "y": pa.array(y, pa.int32())})

        rows = []
        for b in batches:
            for own, text in zip(b.column("own").to_pylist(), b.column("text"), strict=True):
                for k, (w, y) in enumerate(labelled(text.as_py())):
                    rows.append((own, k, w, y))
                    if len(rows) == 5000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text", F.lit(seed)).alias("own"), "text")
    return stored(texts.mapInArrow(label, "own bigint, k int, w binary, y int").dropDuplicates(["own", "k"]), "secret-windows")


def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of bytes and their labels, in an order that depends on the rows only."""
    t = t.sort_by([("own", "ascending"), ("k", "ascending")])
    x = np.frombuffer(b"".join(t["w"].to_pylist()), np.uint8).reshape(-1, LENGTH)
    return x, t["y"].to_numpy().astype(np.int64)


def goes_on(shared, r: int, seed: int):
    """Training of one block in round ``r``, from the network in ``shared``."""

    def go_on(key, t):
        x, y = arrays(t)
        part = ByteConvNet(2, seed=seed)
        part.p = {k: v.copy() for k, v in shared.value.items()}
        part.epoch(x, y, rate=4e-3 / 4 ** (r + 1), seed=(seed, r, key[0].as_py()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(y)], pa.int64()), "p": pa.array([pickle.dumps(part.p)], pa.binary())})

    return go_on


def trained(rows: DataFrame, blocks: int, seed: int) -> ByteConvNet:
    """The network after all rounds over ``rows`` (block, own, k, w, y)."""
    first = rows.where("block = 0") if blocks > 1 else rows  # bounded: a block
    x, y = arrays(first.select("own", "k", "w", "y").toArrow())
    net = ByteConvNet(2, seed=seed).fit(x, y, steps=STEPS)
    for r in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(net.p)

        got, total, mean = rows.groupBy("block").applyInArrow(goes_on(shared, r, seed), "block bigint, n bigint, p binary").collect(), 0, {}
        for part in sorted(got, key=lambda part: part["block"]):  # some 13 KB for each block
            for k, v in pickle.loads(part["p"]).items():
                mean[k] = mean.get(k, 0.0) + part["n"] * v.astype(np.float64)
            total += part["n"]
        net.p = {k: (v / total).astype(np.float32) for k, v in mean.items()}
        shared.destroy()
    return net


def margins(rows: DataFrame, net: ByteConvNet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(margin, label, how often) of all windows of ``rows``, margins rounded down to 1/GRID and within 40."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = margin_of(shared.value, np.frombuffer(b"".join(b.column("w").to_pylist()), np.uint8).reshape(-1, LENGTH))
                at, n = np.unique(np.floor(np.clip(m, -40, 40) * GRID).astype(np.int64) * 2 + b.column("y").to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(n)})

    got = rows.select("w", "y").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()  # 160 * GRID rows at most
    shared.destroy()
    at = got["at"].to_numpy()
    return (at >> 1) / GRID, at & 1, got["n"].to_numpy()


def train(docs: DataFrame, sample_docs: int | None = None, recall: float = RECALL, seed: int = 5, block: int = BLOCK) -> Model | None:
    """Fit on the windows of all documents, or of about ``sample_docs``, chosen by a hash of their text."""
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, docs.count()))
        docs = docs.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / 1e6 < share)
    rows = windows(docs, seed)
    aside = F.pmod(F.xxhash64("own", F.lit(seed)), F.lit(5)) == 0
    seen = {(r["aside"], r["y"]): r["n"] for r in rows.groupBy(aside.alias("aside"), "y").agg(F.count("*").alias("n")).collect()}
    n = [seen.get((False, y), 0) + seen.get((True, y), 0) for y in (0, 1)]
    if sum(n) < 40 or not all(n):
        return None
    whole = not all(seen.get(k) for k in ((True, 1), (False, 0), (False, 1)))  # too few to set some aside
    kept = rows if whole else rows.where(~aside)
    blocks = -(-(sum(n) if whole else seen[False, 0] + seen[False, 1]) // block)
    net = trained(kept.withColumn("block", F.pmod(F.xxhash64("own", F.lit(seed + 1)), F.lit(blocks))), blocks, seed)
    model = settled(net, *margins(rows if whole else rows.where(aside), net), recall)
    drop_scratch(rows)
    return model


def margin_of(net: ByteConvNet, x: np.ndarray) -> np.ndarray:
    z = net.logits(x)
    return z[:, 1] - z[:, 0]


def settled(net: ByteConvNet, margin: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> Model:
    """The model with its scores calibrated, and the threshold taken, on margins that occur ``n`` times."""
    slope, shift = calibrate(margin, y, n=n)
    scores = platt(margin, slope, shift)
    threshold = threshold_for(scores, y, recall, n)
    taken = scores >= threshold
    return Model(net, slope, shift, threshold, float((y * n)[taken].sum() / n[taken].sum()))


def fitted(net: ByteConvNet, x: np.ndarray, y: np.ndarray, recall: float) -> Model:
    """``settled`` on labelled windows that are at hand."""
    return settled(net, margin_of(net, x), y, np.ones(len(y), np.int64), recall)


def found_in(texts: list[str | None], m: Model | None) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, score) for each text, by start and kind."""
    rows, spots, wins, owner = [], [], [], []
    for i, text in enumerate(texts):
        base = base_findings(text or "")
        rows.append([(k, s, e, 1.0) for s, e, k in base])
        if m is not None and text:
            for s, e in candidates(text, base):
                for piece in pieces_of(s, e):
                    owner.append(len(spots))
                    wins.append(window(text, *piece))
                spots.append((i, s, e))
    if wins:
        best = np.zeros(len(spots))
        np.maximum.at(best, owner, m.scores(wins))
        for (i, s, e), p in zip(spots, best, strict=True):
            if p >= m.threshold:
                rows[i].append(("cnn", s, e, float(p)))
    for r in rows:
        r.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return rows


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, findings) with findings as array of (kind, start, end, score), by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in by_bytes(whole, 500):
                rows = found_in(b.column("text").to_pylist(), m)
                listed = pa.array([[dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in r] for r in rows], pa.list_(item))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed], ["doc_id", "findings"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, findings array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The contract's columns for findings of ``kinds`` plus whatever the method added."""
    base = F.filter("findings", lambda f: f["kind"].isin(*kinds))
    listed = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: secrets of every document."""
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs)), KINDS[:3])
