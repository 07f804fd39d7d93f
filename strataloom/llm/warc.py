"""WARC archives as chunked record tables.

Archives are written and read by the executors in the shared folder, as streams: a payload goes out and comes
back in chunks of bounded size, with digests carried from chunk to chunk, and no record is ever held as a whole
by the reader. ``read_chunks`` is the record table: one row per record and chunk number.

Writing goes to a name of the task attempt; the rows that a committed attempt returned name the archives to
read, so a task that is run again or twice leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, delete, new_path, ship

CHUNK = 1 << 20
REVISIT_FROM = 100
#: Groups of equal payloads, about 100 bytes each, that may be broadcast.
BROADCAST_GROUPS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    """File system and path of a URI; a bare path is local or mounted, as in tests."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


def record_id(page_id: int | None, url: str, digest: str) -> str:
    """Rows of equal id, address and payload are one record, written once a row."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}')}>"


def header(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _line(value: str) -> str:
    return " ".join(value.split()) or "urn:none"


def write_records(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, digest, n_bytes, refers_to, refers_url) -> the archive's name and its number of records. A warcinfo record comes first."""
    ctx = TaskContext.get()
    name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc" if ctx else f"{uuid.uuid4().hex}.warc"
    out, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        if out is None:
            fs, base = _fs(_uri(folder))
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{base}/{name}")
            info = b"software: strataloom\r\nformat: WARC File Format 1.1\r\n"
            out.write(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{name}')}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
        cols = [b.column(c) for c in ("page_id", "url", "html", "digest", "n_bytes", "refers_to", "refers_url")]
        for i in range(b.num_rows):
            page, url, digest, size, refers, refers_url = (cols[k][i].as_py() for k in (0, 1, 3, 4, 5, 6))
            uri = _line(url or "")
            body = cols[2][i].as_buffer() if cols[2][i].is_valid and refers is None else None
            fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, uri, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Length", str(size))]
            if refers is not None:
                target = _line(refers_url or "")
                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, target, digest)), ("WARC-Refers-To-Target-URI", target), ("X-Refers-To-Page-ID", str(refers))]
            out.write(header([*fields, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body) if body is not None else 0))]))
            for a in range(0, len(body) if body is not None else 0, CHUNK):
                out.write(body.slice(a, min(CHUNK, len(body) - a)))
            out.write(b"\r\n\r\n")
            n += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])


CHUNKS = "page_id long, record_id string, record_type string, refers_to long, chunk int, chunk_bytes long, payload_bytes long, payload_sha256 string, declared_sha256 string, payload binary, last boolean"
_NAMES = ["page_id", "record_id", "record_type", "refers_to", "chunk", "chunk_bytes", "payload_bytes", "payload_sha256", "declared_sha256", "payload", "last"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]


def _heads(stream) -> Iterator[dict[str, str]]:
    """Header after header of a stream; the caller reads the payload in between."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record ends in its header")
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields


def chunk_rows(folder: str, archive: str, chunk: int, payloads: bool) -> Iterator[tuple]:
    """The record table of one archive, read as a stream; digest and length are those of the payload so far."""
    import io

    fs, base = _fs(_uri(folder))
    with fs.open_input_stream(f"{base}/{archive}") as raw, io.BufferedReader(raw, 1 << 16) as stream:
        for f in _heads(stream):
            left, digest, done, k = int(f["content-length"]), hashlib.sha256(), 0, 0
            if f["warc-type"] == "warcinfo":
                stream.read(left)
                continue
            page = int(f["x-page-id"]) if f.get("x-page-id") else None
            declared = f.get("warc-payload-digest", "").partition(":")[2]
            refers = int(f["x-refers-to-page-id"]) if "warc-refers-to" in f else None
            base_row = (page, f["warc-record-id"], f["warc-type"], refers)
            if refers is not None:
                yield (*base_row, 0, 0, int(f["x-payload-length"]), declared, declared, None, True)
                continue
            while left or not k:
                part = stream.read(min(chunk, left))
                if len(part) < min(chunk, left):
                    raise ValueError("a record ends in its payload")
                digest.update(part)
                left -= len(part)
                done += len(part)
                yield (*base_row, k, len(part), done, digest.hexdigest() if not left else None, declared, part if payloads else None, not left)
                k += 1


def read_chunks(archives: DataFrame, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """Rows (archive) -> the record table, streamed. ``payloads`` False leaves the bytes out, not the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

        for b in batches:
            for name in b.column(0).to_pylist():
                for row in chunk_rows(folder, name, chunk, payloads):
                    held.append(row)
                    size += row[5] if payloads else 0
                    if len(held) >= 4096 or size >= 4 * chunk:
                        yield table()
                        held, size = [], 0
        if held:
            yield table()

    ship(archives.sparkSession)
    return archives.select("archive").mapInArrow(run, CHUNKS)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with digest, n_bytes, refers_to (the smallest page id of an equal payload of REVISIT_FROM bytes or more, not for itself) and its address.

    The digests are Spark's; groups are reduced by partial minima before the shuffle, and only groups of two or
    more are joined back, by digest and length: broadcast up to BROADCAST_GROUPS of them, else by shuffle.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n_bytes": F.octet_length("html").cast("long")})
    big = rows.where((F.col("n_bytes") >= REVISIT_FROM) & F.col("page_id").isNotNull())
    firsts = cut(big.groupBy("digest", "n_bytes").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n_bytes", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")))
    if firsts.count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    refers = F.when((F.col("first") != F.col("page_id")), F.col("first"))
    return rows.join(firsts, ["digest", "n_bytes"], "left").select("page_id", "url", "html", "digest", "n_bytes", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one archive per task; the committed archives' names and record counts come back, kept in the shared folder."""
    ship(pages.sparkSession)
    return cut(planned(pages, id_col, url_col, html_col).mapInArrow(lambda it: write_records(it, folder), "archive string, records long"))


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives.

    Null html is an empty payload, null urls become urn:none; a null page id is a response and refers to nothing.
    Rows with equal ids and payloads are responses all; an empty table gives an empty one. A response whose bytes
    don't give the digest in its header fails the read.
    """
    folder = new_path(spark, "warc")
    archives = archive_pages(pages, folder, id_col, url_col, html_col)
    n = max(1, archives.count())
    table = read_chunks(archives.repartition(n), folder, payloads=False)
    last = table.where("last").select("page_id", "payload_bytes", "payload_sha256", "declared_sha256", "record_type", "refers_to")
    wrong = F.raise_error(F.concat(F.lit("damaged payload of page "), F.col("page_id").cast("string")))
    digest = F.when(F.col("payload_sha256") == F.col("declared_sha256"), F.col("payload_sha256")).otherwise(wrong)
    out = cut(last.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to"))
    delete(spark, folder)
    return out


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND m < page_id THEN m END AS refers_to
FROM f
"""


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
