"""The contract queries against plain Python on a small table with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from sluice.llm.catalogue import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def digest(found, kinds):
    found = sorted(found, key=lambda f: (f[1], kinds.index(f[0])))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


def keyed(got, docs):
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    return {r["doc_id"]: r for r in got}


def test_op1_matches_sql(spark, odd_dir):
    got = sorted(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows(QUERIES["op1_warc"](spark, odd_dir)))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{odd_dir}/pages.parquet'")
    want = sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({ORACLE['op1_warc']})").fetchall(), key=lambda r: r[0])
    assert sorted(got, key=lambda r: r[0]) == want
    assert sum(r[3] == "revisit" for r in got) == 3


def test_op2_components(spark, odd_dir, documents):
    def fp(t):
        w = WORD.findall(lower(t))
        if not w:
            return 0
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d["doc_id"]: fp(d["text"]) for d in documents}
    ids, root = sorted(prints), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows(QUERIES["op2_simhash"](spark, odd_dir))
    assert len(got) == len(documents)
    for r in got:
        assert r["fingerprint"] == format(prints[r["doc_id"]], "016x")
        assert r["component_id"] == find(r["doc_id"])


def test_op3_base(spark, odd_dir, documents):
    kinds = ("assign", "access", "hex")
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    got = rows(QUERIES["op3_secrets"](spark, odd_dir))
    by_id = keyed(got, documents)
    for d in documents:
        t = d["text"] or ""
        found = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        r, n = by_id[d["doc_id"]], Counter(f[0] for f in found)
        assert [r[f"n_{k}"] for k in kinds] == [n[k] for k in kinds]
        assert r["base_sha256"] == digest(found, kinds)
        assert {f"{k}:{s}:{e}" for k, s, e in found} <= set(r["spans"].split(","))


def test_op5_counts(spark, odd_dir, documents):
    by_id = keyed(rows(QUERIES["op5_quality"](spark, odd_dir)), documents)
    for d in documents:
        t = d["text"] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                covered |= {i, i + 1, i + 2}
        seen, dups = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(covered), failed)
        r = by_id[d["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and r["kept"])


def test_op6_base_and_model(spark, odd_dir, documents):
    from sluice.llm.ctw import DEPTH

    out = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2
    tokens = lambda d: [*WORD.findall(lower(d["text"])), None]
    count = Counter(t for d in documents if not out(d) for t in tokens(d))
    n, v = sum(count.values()), len(count)
    # the plain recursion of context-tree weighting, node by node
    tree: dict = {}
    for d in documents:
        data = b"\0" * DEPTH + lower(d["text"]).encode() + b"\0"
        for i in range(DEPTH, len(data)):
            for k in range(8):
                bit = data[i] >> (7 - k) & 1
                for depth in range(DEPTH + 1):
                    node = tree.setdefault((1 << k | data[i] >> (8 - k), data[i - depth : i]), [0, 0, set()])
                    node[bit] += not out(d)
                    if depth < DEPTH:
                        node[2].add(data[i - depth - 1 : i])
    memo: dict = {}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_pw(key):
        if key not in memo:
            a, b, below = tree[key]
            own = log_kt(a, b)
            memo[key] = own if len(key[1]) == DEPTH else math.log(0.5) + np.logaddexp(own, sum(log_pw((key[0], c)) for c in below))
        return memo[key]

    def bit_probability(part, context, bit, depth=DEPTH):
        p = None
        for d in range(depth, -1, -1):
            key = (part, context[len(context) - d :])
            a, b, _ = tree[key]
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            p = own if p is None else (w := math.exp(math.log(0.5) + log_kt(a, b) - log_pw(key))) * own + (1 - w) * p
        return p

    got = rows(QUERIES["op6_lm_score"](spark, odd_dir))
    by_id = keyed(got, documents)
    for d in documents:
        ts = tokens(d)
        r = by_id[d["doc_id"]]
        assert r["held_out"] == out(d) and r["train_tokens"] == n
        assert r["n_tokens"] == len(ts) and r["n_known"] == sum(count[t] > 0 for t in ts)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    for d in sorted(documents, key=lambda d: len(d["text"] or ""))[:40]:
        data, total = b"\0" * DEPTH + lower(d["text"]).encode() + b"\0", 0.0
        for i in range(DEPTH, len(data)):
            for k in range(8):
                total += math.log10(bit_probability(1 << k | data[i] >> (8 - k), data[i - DEPTH : i], data[i] >> (7 - k) & 1))
        assert by_id[d["doc_id"]]["score"] == pytest.approx(total, rel=1e-6)
    bits = [r["bits_per_byte"] for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert np.mean(bits) < 4


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_op7_base(spark, odd_dir, documents):
    kinds = ("email", "ip", "card", "phone")
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    by_id = keyed(rows(QUERIES["op7_pii"](spark, odd_dir)), documents)
    total = 0
    for d in documents:
        t = d["text"] or ""
        found = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, t) if ok(m[0])]
        r, n = by_id[d["doc_id"]], Counter(f[0] for f in found)
        total += len(found)
        assert [r[f"n_{k}"] for k in kinds] == [n[k] for k in kinds], (t[:200], found, r)
        assert r["base_sha256"] == digest(found, kinds), (t[:300], found, r)
        added = [s for s in r["spans"].split(",") if s.startswith("term:")]
        assert found or not added
        for s in added:
            _, a, b = s.split(":")
            assert t[int(a) : int(b)].isalpha()
    assert total > 20


def test_op9_accuracy(spark, odd_dir, documents):
    by_id = keyed(rows(QUERIES["op9_langid"](spark, odd_dir)), documents)
    right = seen = 0
    for d in documents:
        r, t = by_id[d["doc_id"]], d["text"] or ""
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t))
        assert 0 <= r["score"] <= 1
        if r["held_out"] and d["doc_id"] < 10_000 and len(t) > 100:
            seen += 1
            right += r["lang_pred"] == d["lang"]
    assert right >= 0.9 * seen > 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []
