"""WARC archives: per-record gzip writer and a reader that splits anywhere.

Writing: every task streams its rows into archives of its own, named at
random, and returns one manifest row per finished archive. The manifest is a
table in the shared folder; archives of lost or repeated task attempts are not
in it and are never read.

Reading: archives are cut into byte ranges, and a record belongs to the range
that its member starts in. A first pass over the ranges looks for the gzip
magic, takes a candidate only if the member decodes (CRC included) and starts
with ``WARC/``, and walks from member to member; it reports where a range's
first member starts and where the member behind its last one does. Then the
ranges of each archive are put together from its first byte on: one whose first
member is not where the range before it ended began in an archive stored inside
a payload, and is walked again from the right place. The second pass returns
the records. So records are the same wherever ranges are cut, and none is read
from inside another. A damaged member is left out: the walk goes on at the next
sound member behind its start (which is foreign only if the damaged record held
an uncompressed archive itself). A record is held in memory as a whole.

Nulls: a null payload is written as an empty one; a null id becomes the record
id ``urn:page:null`` and is read back as null; a null URL gives no target
header. An empty table gives an empty archive set and an empty result. Rows
that repeat the id and payload of a response are responses too.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import scratch_dir, stored

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT_BYTES = 100
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add payload (binary), payload_digest and refers_to.

    Only payloads that occur twice reach the join, and their table is written
    first: its size is known when the join is planned, so it is broadcast only
    if it is small. Pages with a payload of their own never leave their task
    in that case.
    """
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_digest", F.sha2("payload", 256))
    shared = base.where(F.length("payload") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = base.join(stored(shared, "warc-shared"), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader"))).drop("leader")


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda n: f"<urn:page:{'null' if n is None else n}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(classified: DataFrame, folder: str, level: int = 5, max_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``classify``'s rows as .warc.gz files; returns the stored manifest (path, bytes, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    name, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                member = gzip_member(record_bytes(page_id, url, payload, digest, refers_to, date), level)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= max_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        rel = [f"{folder.rstrip('/')}/{n.rsplit('/', 1)[1]}" for n, _, _ in done]
        yield pa.RecordBatch.from_pydict({"path": pa.array(rel, pa.string()), "bytes": pa.array([s for _, s, _ in done], pa.int64()), "records": pa.array([c for _, _, c in done], pa.int64())})

    rows = classified.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return stored(rows.mapInArrow(write, "path string, bytes bigint, records bigint"), "warc-manifest")


def parse_headers(text: bytes) -> dict[str, str] | None:
    """Header fields in lower case, or None if this is no WARC header."""
    lines = text.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return None
    pairs = (line.partition(b":") for line in lines[1:] if line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def read_member(f, at: int, chunk: int = 1 << 16) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and where it ends; None if there is no whole WARC member."""
    z, parts, pos, have = zlib.decompressobj(31), [], at, 0
    f.seek(at)
    try:
        while not z.eof:
            data = f.read(chunk)
            if not data:
                return None
            pos += len(data)
            parts.append(z.decompress(data))
            have += len(parts[-1])
            if have >= 5:
                if not (parts[0] if len(parts[0]) >= 5 else b"".join(parts)).startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    return b"".join(parts), pos - len(z.unused_data)


def find_magic(f, at: int, end: int, size: int, chunk: int = 1 << 20) -> int | None:
    """First offset in [at, end) where the gzip magic stands."""
    while at < end:
        f.seek(at)
        data = f.read(min(chunk, end - at + 2, size - at))
        if (i := data.find(MAGIC)) >= 0 and at + i < end:
            return at + i
        if len(data) <= 2:
            return None
        at += len(data) - 2
    return None


def walk(f, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(position, position behind, raw record) of the sound members from ``start`` on that start before ``end``.

    Behind what is no member the walk goes on at the next sound one.
    """
    pos = start
    while pos is not None and pos < end:
        if got := read_member(f, pos):
            yield pos, got[1], got[0]
            pos = got[1]
        else:
            pos = find_magic(f, pos + 1, end, size)


def guessed(f, size: int, start: int, end: int) -> tuple[int, int]:
    """Like ``bounds``, without knowing where the range's first member starts.

    A chain of members that runs into other bytes lay in an archive inside a
    payload, unless something is damaged; the guess goes on behind it.
    """
    first, behind = -1, -1
    for pos, after, _ in walk(f, size, start, end):
        if first >= 0 and pos != behind and first > 0:
            first = -1
        first, behind = pos if first < 0 else first, after
    if first > 0 and behind < end:
        f.seek(behind)
        if behind < size and f.read(3) != MAGIC:
            return -1, -1
    return first, behind


def bounds(f, size: int, start: int, end: int) -> tuple[int, int]:
    """Where the first member of ``walk`` starts, and where the one behind its last would; -1 where there is none."""
    first, behind = -1, -1
    for pos, after, _ in walk(f, size, start, end):
        first, behind = pos if first < 0 else first, after
    return first, behind


def read_range(f, size: int, start: int, end: int, at: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose member starts in [start, end); ``at`` is the first of them, else it is guessed."""
    at = guessed(f, size, start, end)[0] if at is None else at
    for _, _, raw in walk(f, size, at, end) if at >= 0 else ():
        top, gap, rest = raw.partition(b"\r\n\r\n")
        if gap and (head := parse_headers(top)) is not None:
            yield head, rest[: int(head["content-length"]) if head.get("content-length", "").isdigit() else len(rest)]


def settle(f, size: int, ranges: list[tuple[int, int, int, int]]) -> list[int]:
    """The true first member of each range (start, end, first, behind), in order from the file's first byte; -1: none.

    ``due`` is where the members so far end. Where it stands before a range,
    something was damaged, and the walk goes on at the range's first sound member.
    """
    out, due = [], 0
    for start, end, first, behind in ranges:
        if due >= end:  # a record reaches over the whole range
            out.append(-1)
            continue
        if first != due or due < start:
            first, behind = bounds(f, size, max(due, start), end)
        out.append(first)
        if first >= 0:
            due = behind
    return out


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def to_row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = head.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
    told = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        digest, length, payload = told, int(head.get("warc-payload-length", 0)), None
    else:
        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
        if told and len(told) == 64 and told != digest:
            raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
    return page_of(head.get("warc-record-id")), head.get("warc-target-uri"), kind, page_of(head.get("warc-refers-to")), digest, length, payload if with_payload else None


def located_ranges(manifest: DataFrame, range_bytes: int) -> DataFrame:
    """(path, bytes, start, first), stored: the archives' byte ranges and the first member of each."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    found.append(guessed(f, size, start, min(size, start + range_bytes)))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("bytes"), b.column("start"), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["path", "bytes", "start", "first", "behind"])

    def put_together(key, t):
        t = t.sort_by("start")
        path, size = key[0].as_py(), t["bytes"][0].as_py() if len(t) else 0
        fs, name = open_fs(path)
        rows = [(s, min(size, s + range_bytes), a, b) for s, a, b in zip(*(t[c].to_pylist() for c in ("start", "first", "behind")), strict=True)]
        with fs.open_input_file(name) as f:
            first = settle(f, size, rows)
        return pa.table({"path": t["path"], "bytes": t["bytes"], "start": t["start"], "first": pa.array(first, pa.int64())})

    seen = ranges.repartition(int(n)).mapInArrow(look, "path string, bytes bigint, start bigint, first bigint, behind bigint")
    return stored(seen.groupBy("path").applyInArrow(put_together, "path string, bytes bigint, start bigint, first bigint").where("first >= 0"), "warc-ranges")


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Rows of RECORDS for all archives of a manifest (path, bytes), one task per byte range."""
    ranges = located_ranges(manifest, range_bytes)
    n = max(1, ranges.count())
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for path, size, start, first in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start", "first")), strict=True):
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for head, block in read_range(f, size, start, min(size, start + range_bytes), first):
                        rows.append(to_row(head, block, with_payload))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 500 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges.repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, range_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """Archive every page and read the archives back."""
    spark = pages.sparkSession
    manifest = write_archives(classify(pages), scratch_dir(spark, "warc"))
    return read_archives(spark, manifest, range_bytes, with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per page from the archives read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS n, sha256(html) AS dig FROM p
), l AS (
  SELECT dig, min(page_id) AS leader FROM d WHERE n >= 100 GROUP BY dig
)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.dig AS payload_digest,
       CASE WHEN l.leader IS NULL OR l.leader = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN l.leader <> d.page_id THEN l.leader END AS refers_to
FROM d LEFT JOIN l ON d.dig = l.dig AND d.n >= 100
"""
