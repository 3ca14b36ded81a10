"""WARC archives: a writer, and a sequential reader (operator 8).

Method of the reader: an archive is read in order, in blocks of fixed size; every
record is one gzip member, decompressed incrementally with zlib; headers and
content length frame the record; block and payload digests are verified.

The writer stores a payload once: of the rows with equal payloads the one with
the smallest id becomes a ``response`` record, the others ``revisit`` records that
refer to it and hold only the HTTP head. Each task writes its own archives, under
a name of its own attempt, into the shared folder; the manifest that is stored
beside them lists the archives of the attempts that succeeded, and only those
are read. A repeated or lost attempt therefore leaves no double records.

Defined results:
* null payloads count as empty; payloads shorter than ``min_revisit_bytes`` are
  always responses;
* null ids are written as such, are never the smallest and read back as null; rows
  that repeat both id and payload are written one by one, with the same role;
* very long payloads are one record each, in memory once per task;
* an empty table gives no archives and no rows; other columns than id, URL and
  payload are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.batches import shipped, slices
from parley.session import ensure_checkpoint_dir

#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 512 << 20
READ_BYTES = 1 << 16
WARC_DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("archive string, position bigint, page_id string, url string, record_type string, payload_bytes bigint, "
                 "payload_digest string, refers_to string, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:id:{quote(str(page_id), safe='')}>"


def _page_of(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:id:(.*)>", urn or "")
    return unquote(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member, read once in order."""
    unpacker, parts, start, seen = zlib.decompressobj(31), [], 0, 0
    data = stream.read(read_bytes)
    while data:
        parts.append(unpacker.decompress(data))
        seen += len(data) - len(unpacker.unused_data)
        if unpacker.eof:
            yield start, b"".join(parts)
            data, unpacker, parts, start = unpacker.unused_data, zlib.decompressobj(31), [], seen
            if data:
                continue
        data = stream.read(read_bytes)
    if parts and not unpacker.eof:
        raise ValueError(f"the member at {start} is cut off")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Named fields, payload and full payload length of one record; raises where
    framing or a digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, field = _fields(head)
    if not gap or not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    length = int(field["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("the content length does not frame the record")
    if "sha1:" + sha1_base32(block) != field["warc-block-digest"]:
        raise ValueError("block digest mismatch")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(_fields(http)[1]["content-length"])
    if field["warc-type"] == "response" and (
            len(payload) != full or "sha1:" + sha1_base32(payload) != field["warc-payload-digest"]):
        raise ValueError("payload digest mismatch")
    return field, payload, full


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to``. Payloads are compared by digest and
    length on narrow rows; a payload that a third of all rows share is counted with
    map-side aggregation and its rows stay apart, keyed by their ids."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    ids = rows.where(F.length("payload") >= min_revisit_bytes).select("page_id", "sha")
    first = ids.groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).where("n > 1")
    revisits = (ids.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                .select(F.col("page_id").alias("of_id"), F.col("sha").alias("of_sha"), "refers_to").distinct())
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha")), "left").select(
        "page_id", "url", "payload", F.col("of_sha").isNotNull().alias("revisit"), "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per row into ``folder`` and return its manifest
    (``archive, n_records, n_bytes``), which is stored at ``folder/manifest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name = out = None
        n = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": f"{folder}/{name}", "n_records": n, "n_bytes": size}])

        for part in slices(batches, "payload"):
            for row in part.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = with_roles(shipped(pages), id_col, url_col, payload_col, min_revisit_bytes)
    manifest = rows.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, one archive a task at a time."""
    def rows(archive: str) -> Iterator[dict]:
        files, path = fs.FileSystem.from_uri(archive)
        with files.open_input_stream(path, compression=None) as stream:
            for at, data in members(stream):
                field, payload, full = parse(data)
                yield {
                    "archive": archive, "position": at, "page_id": _page_of(field["warc-record-id"]), "url": unquote(field["warc-target-uri"]),
                    "record_type": field["warc-type"], "payload_bytes": full, "payload_digest": field["warc-payload-digest"].removeprefix("sha1:"),
                    "refers_to": _page_of(field.get("warc-refers-to")), "payload": payload if payloads and field["warc-type"] == "response" else None}

    types = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("page_id", pa.string()), ("url", pa.string()),
                       ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                for row in rows(archive):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=types)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=types)

    n = manifest.count()
    return shipped(manifest).select("archive").repartition(max(1, n)).mapInArrow(run, RECORD_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, in the storage that the cluster shares."""
    shared = ensure_checkpoint_dir(spark)
    if "://" not in shared:
        shared = "file://" + re.sub(r"^file:", "", shared)
    return f"{shared}/warc-{uuid.uuid4().hex}"


def archived(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
             payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to`` of every record, ids in their own type."""
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or archive_folder(spark), id_col, url_col, payload_col, min_revisit_bytes)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, manifest, payloads=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
