"""Archives with damage and with archives inside, read at many cuts."""

from __future__ import annotations

import hashlib
import os
import random

from sluice.llm import warc


def member(i, payload, level=5):
    return warc.gzip_member(warc.record_bytes(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, "d"), level)


def read(spark, path, cut):
    size = os.path.getsize(path)
    manifest = spark.createDataFrame([(f"file://{path}", size)], "path string, bytes bigint")
    return sorted(r["page_id"] for r in warc.read_archives(spark, manifest, cut, with_payload=False).collect())


def test_every_cut_gives_the_same_records(spark, tmp_path):
    rng = random.Random(3)
    inner = b"".join(member(9000 + i, rng.randbytes(300), 0) for i in range(30))
    members = [member(i, inner + b"tail" if i % 25 == 7 else rng.randbytes(rng.randint(0, 900)), 0 if i % 3 else 5) for i in range(120)]
    members[100] = b"\0\0\0" + members[100][3:]
    half = len(members[60]) // 2
    members[60] = members[60][:half] + b"\xff\xfe\xfd" + members[60][half + 3 :]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    want = [i for i in range(120) if i not in (60, 100)]
    for cut in (701, 3000, 4000, 20_000, 1 << 20):
        assert read(spark, path, cut) == want, cut


def test_megabytes_in_a_record(spark, tmp_path):
    path = tmp_path / "b.warc.gz"
    path.write_bytes(member(0, b"a") + member(1, os.urandom(3_000_000)) + member(2, b"c" * 5_000_000) + member(3, b""))
    for cut in (100_000, 8 << 20):
        assert read(spark, path, cut) == [0, 1, 2, 3]
