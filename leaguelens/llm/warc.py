"""WARC archives with an index written first.

Each task writes its pages as gzip members into one archive and reports offset, length,
URL and digest of every record; these rows are the index, a Parquet table. Reading starts
from it: the selected records are dealt to tasks by archive and stretch, sorted by offset,
and fetched in coalesced byte ranges.

A task that is run again writes a new archive, and only the rows of the attempt that
Spark commits enter the index, so records are neither lost nor doubled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PAYLOAD = 0  # payloads of fewer bytes are never written as revisits
GAP = 64 << 10  # bytes between two records that are read rather than skipped
RANGE = 4 << 20  # bytes fetched at once, unless one record is longer
STRETCH = 32 << 20  # bytes of an archive that one reading group takes
GZIP_LEVEL = 6
NAMESPACE = "urn:leaguelens:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that equal input gives equal archives

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{NAMESPACE}{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(NAMESPACE)
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record; a revisit has no block and names the page that it repeats."""
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(revisit_of))]
    block = b"" if revisit else payload
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it states")
    return headers, rest[:size]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str):
    """Write a task's pages into one archive and yield its index rows."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        name, out, offset = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = {k: [] for k in ("archive", "offset", "length", "url", "digest", "page_id", "record_type")}
            for page, url, html, first, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = html or b""
                digest = payload_digest(payload)
                revisit = bool(twice) and len(payload) >= LEAST_PAYLOAD and page != first
                data = _gzip(record(page, url, payload, digest, first, revisit))
                out.write(data)
                kind = "revisit" if revisit else "response"
                for k, v in zip(rows, (name, offset, len(data), url, digest, page, kind), strict=True):
                    rows[k].append(v)
                offset += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record for every row of ``pages`` below ``folder`` and return the index, read back from there.

    Of rows with equal payloads the one with the largest key is a response and the
    others are revisits of it; rows that share that key are responses all. A null
    payload is empty, a null URL is kept as empty, and null keys revisit any other
    key. ``folder`` must be reachable by all executors. Other columns are ignored.
    """
    spark = pages.sparkSession
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), content.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    # only payloads that occur more than once, as a table: Spark knows its size when it plans the join
    again = rows.groupBy("sha").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again.select("sha", "first").write.parquet(f"{folder}/repeated")
    again = spark.read.parquet(f"{folder}/repeated")
    joined = rows.join(again.withColumn("twice", F.lit(True)), "sha", "left")
    index = joined.select("page", "url", "html", "first", "twice").mapInArrow(_write(_made(folder, "archives")), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _made(folder: str, name: str) -> str:
    """A folder below ``folder``, made if absent."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/{name}", recursive=True)
    return f"{folder}/{name}"


def _ranges(entries: list[tuple[int, int]]):
    """Coalesce records (offset, length), sorted by offset: (start, end, entries) of each range to read."""
    held: list[tuple[int, int]] = []
    for at, size in entries:
        if held and (at - end > GAP or at + size - held[0][0] > RANGE):
            yield held[0][0], end, held
            held = []
        held.append((at, size))
        end = max(end, at + size) if len(held) > 1 else at + size
    if held:
        yield held[0][0], end, held


def _read(folder: str):
    """Fetch a task's sorted records and yield what they say."""

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            by_archive: dict[str, list[tuple[int, int]]] = {}
            for archive, at, size in zip(*columns, strict=True):
                by_archive.setdefault(archive, []).append((at, size))
            for archive, entries in by_archive.items():
                if archive != name:
                    name, file = archive, store.open_input_file(f"{path}/{archive}")
                for start, end, held in _ranges(entries):
                    data = memoryview(file.read_at(end - start, start))
                    yield _said([zlib.decompress(data[at - start : at - start + size], 31) for at, size in held])

    return run


def _said(records: list[bytes]) -> pa.RecordBatch:
    out = []
    for data in records:
        headers, block = parse(data)
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and payload_digest(block) != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        refers = _number(headers.get("WARC-Refers-To"))
        out.append((_number(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), digest, kind, refers))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_records(spark: SparkSession, folder: str, selected: DataFrame | None = None) -> DataFrame:
    """What the records of the index, or the ``selected`` rows of it, say: one row each.

    Every record is parsed, and the payload of every response is held against its digest.
    """
    index = spark.read.parquet(f"{folder}/index") if selected is None else selected
    stretch = F.floor(F.col("offset") / STRETCH)
    entries = index.select("archive", "offset", "length", stretch.alias("stretch"))
    dealt = entries.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(_read(f"{folder}/archives"), RECORD)


def round_trip(pages: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """Write ``pages`` as archives and read all records back: key, payload_bytes, payload_digest, record_type, refers_to."""
    write_archives(pages, folder, key)
    return read_records(pages.sparkSession, folder).withColumnRenamed("page_id", key)
