"""A deterministic, sharded WARC 1.1 writer and its reader.

Records are range-sorted by key, each task writes its range to files that roll
over at a compressed size, and every file is written under a temporary name and
renamed when whole.  The manifest, a table of the files of the tasks that
committed, is what makes files count: files of lost attempts are never listed.
Equal input gives equal files, whatever ran twice.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

FILE_BYTES = 16 << 20
SHARD_BYTES = 24 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
_SALTS = 32

MANIFEST = "file string, bytes long, sha256 string, records long, first_key string, last_key string"


def record_id(page_id: object) -> str:
    """A UUID that depends on the page alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _digest(raw: bytes) -> str:
    return "sha256:" + hashlib.sha256(raw).hexdigest()


def clean_header(value: object) -> str:
    """A header value: line breaks and other control characters percent-encoded, so no value can end its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def build_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, size: int | None = None, digest: str | None = None) -> bytes:
    """One uncompressed record; lengths and digests are computed here from the payload, or given for a revisit that comes without it."""
    size, digest = len(payload) if size is None else size, digest or _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: {_digest(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {clean_header(page_id)}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_header(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {clean_header(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member with a fixed header, so that equal records are equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The members of a gzip file that comes in chunks, one at a time."""
    d, parts = None, []
    for data in chunks:
        while data:
            d = d or zlib.decompressobj(31)
            parts.append(d.decompress(data))
            data = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts = None, []
    if d is not None:
        raise ValueError("a gzip member is cut short")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its length and block digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _digested(pages: DataFrame, payload: str) -> tuple:
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    return raw, F.sha2(raw, 256)


def plan_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The rows that become revisits, without payloads: of equal payloads of at least 100 bytes all but those of the smallest key.

    Digests, not payloads, are compared and shuffled.  The smallest key of each
    digest is found with map-side partial minima, and the way back is salted, so
    that a payload shared by a third of all pages loads no single task.
    """
    raw, digest = _digested(pages, payload)
    marks = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"), digest.alias("_digest"), F.length(raw).cast("long").alias("_n")).where(F.col("_n") >= MIN_REVISIT_BYTES)
    first = marks.groupBy("_digest").agg(F.min("_key").alias("_ref"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    spread = first.select(F.col("_digest").alias("_d"), "_ref", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_s"))
    salted = marks.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(_SALTS)).cast("int"))
    refs = salted.join(spread, (salted["_digest"] == spread["_d"]) & (salted["_salt"] == spread["_s"])).where(F.col("_key") > F.col("_ref"))
    return refs.select("_key", "url", "_digest", "_n", "_ref")


def _shard_of(edges: list[tuple]):
    @F.pandas_udf("int")
    def shard(key: pd.Series, tie: pd.Series) -> pd.Series:
        rows = zip(key.tolist(), key.isna().tolist(), tie.tolist(), strict=True)
        return pd.Series([bisect.bisect_right(edges, (0, 0, t) if null else (1, k, t)) for k, null, t in rows], dtype="int32")

    return shard


def shard_edges(rows: DataFrame, key: str, tie: str, size: str, shard_bytes: int = SHARD_BYTES, sample: int = 20_000) -> list[tuple]:
    """Cut points of ranges of about ``shard_bytes`` of payload, from a sample chosen by hash.

    The sample, and so the shards, depend on the rows alone, not on partitions
    or on what ran before; it holds ``sample`` keys or so, whatever the input,
    each weighed by its bytes.  Rows are drawn by key and content together, so
    a page that stands under many keys is drawn in proportion.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    shards = -(-int(total["b"]) // shard_bytes)
    if shards < 2:
        return []
    every = max(1, int(total["n"]) // sample)
    picked = rows.select(F.col(key).alias("k"), F.col(tie).alias("t"), F.col(size).alias("b")).where(F.pmod(F.xxhash64("k", "t"), F.lit(every)) == 0)
    weight = {(0, 0, r["t"]) if r["k"] is None else (1, r["k"], r["t"]): r["b"] or 0 for r in picked.groupBy("k", "t").agg(F.sum("b").alias("b")).collect()}
    order = sorted(weight)
    upto = list(itertools.accumulate(weight[x] for x in order))
    return sorted({order[bisect.bisect_left(upto, upto[-1] * i / shards)] for i in range(1, shards)}) if order else []


def _write_files(folder: str, file_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple] = []
        out, shard, roll, temp, sha, size, count, first, last = None, None, 0, "", None, 0, 0, "", ""
        revisit = None

        def close() -> None:
            nonlocal out, roll
            if out is None:
                return
            out.close()
            name = f"part-{shard:06d}-{roll:05d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            done.append((name, size, sha.hexdigest(), count, first, last))
            out, roll = None, roll + 1

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.payload is not None and revisit == (row.key, row.tie):
                    continue  # the payload of a row that was written as a revisit just before
                if row.payload is None:
                    revisit = (row.key, row.tie)
                if row.shard != shard:
                    close()
                    shard, roll = row.shard, 0
                if out is None:
                    temp, size, sha, count, first = f"{root}/.{shard}-{roll}-{attempt}.tmp", 0, hashlib.sha256(), 0, row.key
                    out = fs.open_output_stream(temp, compression=None)
                raw = gzip_member(build_record(row.key, row.url, bytes(row.payload or b""), row.ref, None if row.ref is None else int(row.n), row.digest))
                out.write(raw)
                sha.update(raw)
                size, count, last = size + len(raw), count + 1, row.key
                if size >= file_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["file", "bytes", "sha256", "records", "first_key", "last_key"])

    return write


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``pages`` as gzip WARC files in ``folder`` and returns the committed manifest.

    A null payload is an empty one, a null URL or key leaves its header out,
    pages smaller than 100 bytes are never revisits, and extra columns are
    ignored.  Rows that repeat a key get a record each; those of one key never
    revisit one another.  An empty table writes no file and an empty manifest.
    """
    base = pages.select(F.col(key).alias("_k"), F.col(url).alias("url"), F.col(payload).alias("_p"))
    raw, digest = _digested(base, "_p")
    none = lambda t: F.lit(None).cast(t)
    whole = base.select("_k", F.xxhash64("url", digest).alias("tie"), "url", raw.alias("payload"), none("string").alias("ref"), F.lit(0).cast("long").alias("n"), none("string").alias("digest"))
    again = plan_revisits(base, "_k", "url", "_p")
    again = again.select(F.col("_key").alias("_k"), F.xxhash64("url", "_digest").alias("tie"), "url", none("binary").alias("payload"), F.col("_ref").cast("string").alias("ref"), F.col("_n").alias("n"), F.concat(F.lit("sha256:"), "_digest").alias("digest"))
    rows = whole.unionByName(again)  # a revisit stands just before its payload, which the writer then leaves out
    sizes = pages.select(F.col(key).alias("_k"), F.xxhash64(F.col(url), F.sha2(F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8"), 256)).alias("tie"), F.octet_length(F.col(payload)).alias("_n"))
    edges = shard_edges(sizes, "_k", "tie", "_n", shard_bytes)
    sharded = rows.withColumn("shard", _shard_of(edges)("_k", "tie")).repartitionById(len(edges) + 1, "shard").sortWithinPartitions("shard", "_k", "tie", F.col("payload").isNotNull())
    return stored(sharded.select("shard", F.col("_k").cast("string").alias("key"), "tie", "url", "payload", "ref", "n", "digest").mapInPandas(_write_files(folder, file_bytes), MANIFEST))


READ = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, file string"


_COLUMNS = [c.split()[0] for c in READ.split(", ")]


def _records(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, want in zip(batch["file"], batch["sha256"], strict=True):
                sha, rows, held = hashlib.sha256(), [], 0

                def chunks(source, sha=sha) -> Iterator[bytes]:
                    while data := source.read(1 << 20):
                        sha.update(data)
                        yield data

                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for raw in members(chunks(source)):
                        headers, block = parse_record(raw)
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                        rows.append((headers.get("X-Page-ID"), headers.get("WARC-Target-URI"), kind, body if kind == "response" else None, length, digest, headers.get("X-Refers-To-Page-ID"), name))
                        held += len(body) + 500
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, held = [], 0
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} differs from its manifest")
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return read


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the files that ``manifest`` lists, streamed; every file, block and payload digest is verified."""
    files = max(1, manifest.count())
    return manifest.select("file", "sha256").repartition(min(files, 10_000), "file").mapInPandas(_records(folder), READ)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns one row per record that was read."""
    spark = pages.sparkSession
    folder = shared_dir(spark) + "/warc"
    manifest = write_warc(pages, folder, key, url, payload)
    kind = pages.schema[key].dataType
    read = read_warc(folder, manifest)
    return read.select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url", "file")

