"""WARC archives in which a repeated payload is stored once: digests shuffled as headers, revisits joined to responses."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_fs, write_parts
from .shared import lookup, scratch, staged, text_or_empty

#: Smaller payloads are always stored in full.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4


def decide(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, size, digest, refers_to, refers_to_url`` for every row of ``pages``.

    ``refers_to`` is null for responses. Of the rows with one payload (null: empty) of at least ``least`` bytes, those
    with the largest key are responses, the rest (rows with a null key too, unless all keys are null) refer to it. Only
    digests, sizes and keys are shuffled to find the groups; a payload that many rows share is looked up by broadcast.
    """
    payload = F.encode(text_or_empty(html), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    best = F.max(F.struct("page_id", "url"))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(best.alias("best"), F.count("*").alias("members"))
    groups = staged(groups.where(F.col("members") > 1).select("digest", F.col("best.page_id").alias("original"), F.col("best.url").alias("original_url"), "members"), "digests")
    again = ~F.col("page_id").eqNullSafe(F.col("original"))
    found = lookup(rows, groups, "digest", "members")
    return found.select("page_id", "url", "payload", "size", "digest", F.when(again, F.col("original")).alias("refers_to"), F.when(again, F.col("original_url")).alias("refers_to_url"))


def record_id(page: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a task that runs again writes the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_to_url: str | None, date: str) -> bytes:
    """One record with fresh headers; a revisit holds the response's own headers without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
        if refers_to_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_to_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    """The record that opens an archive and says what wrote it."""
    block = b"software: wavelattice\r\nformat: WARC File Format 1.1\r\n"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"archive:{name}:{date}")
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(decided: DataFrame, folder: str, *, date: str | None = None) -> list[dict]:
    """One archive a partition, a compressed member for each record; returns the index of files.

    ``date``: that of all records; without one, the time at which the job is made, in UTC.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def encode(batches: Iterator[pa.RecordBatch], facts: dict) -> Iterator[bytes]:
        yield _member(info_record(f"part-{TaskContext.get().partitionId():06d}.warc.gz", date))
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                yield _member(record(*row, date))
                facts["rows"] += 1

    lean = decided.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return write_parts(lean.select("page_id", "url", "payload", "size", "digest", "refers_to", "refers_to_url"), folder, ".warc.gz", encode)


def read_members(uri: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed records of an archive, one at a time."""
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        data, unpacker, held = f.read(chunk), None, []
        while data:
            unpacker = unpacker or zlib.decompressobj(31)
            held.append(unpacker.decompress(data))
            if unpacker.eof:
                yield b"".join(held)
                data, unpacker, held = unpacker.unused_data, None, []
                data = data or f.read(chunk)
            else:
                data = f.read(chunk)
        if unpacker is not None:
            raise ValueError(f"{uri} ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """Headers and block of a record, and the block's own headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if not lines[0].startswith("WARC/") or len(rest) != len(block) + 4:
        raise ValueError("a record is damaged")
    inner, _, payload = block.partition(b"\r\n\r\n")
    return headers, block, dict(line.split(": ", 1) for line in inner.decode().split("\r\n")[1:] if line), payload


RECORDS = "record_id string, page_id long, url string, record_type string, digest string, payload binary, refers_to_id string, refers_to long"
_RECORDS = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("refers_to_id", pa.string()), ("refers_to", pa.int64())]
)


def read_archives(spark: SparkSession, index: list[dict]) -> DataFrame:
    """The records of the archives; a response whose payload does not have its digest fails the job."""
    import hashlib

    n = len(index)

    def rows(uri: str) -> Iterator[dict]:
        for data in read_members(uri):
            headers, _, _, payload = parse(data)
            if (kind := headers["WARC-Type"]) not in ("response", "revisit"):
                continue
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{uri}: {headers['WARC-Record-ID']} has another digest")
            number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
            yield {
                "record_id": headers["WARC-Record-ID"],
                "page_id": number("X-Page-ID"),
                "url": headers.get("WARC-Target-URI"),
                "record_type": kind,
                "digest": digest,
                "payload": payload if kind == "response" else None,
                "refers_to_id": headers.get("WARC-Refers-To"),
                "refers_to": number("X-Refers-To-Page"),
            }

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(index[k]["path"]):
                    held.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)

    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Headers of all records with ``payload_bytes`` of the full payload: revisits get it from their response.

    Headers only are shuffled, by the response's id; a response that very many records revisit is looked up by
    broadcast. A revisit without its response keeps a null.
    """
    heads = staged(records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "headers")
    revisits = heads.where("record_type = 'revisit'").drop("payload_bytes")
    pointed = revisits.groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("members"))
    originals = heads.where("record_type = 'response'").select("record_id", "payload_bytes").dropDuplicates(["record_id"]).join(pointed, "record_id")
    originals = staged(originals.withColumnRenamed("record_id", "refers_to_id"), "originals")
    found = lookup(revisits, originals, "refers_to_id", "members").drop("members")
    return heads.where("record_type = 'response'").unionByName(found.select(*heads.columns))


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write deduplicated archives of ``pages`` into a new scratch folder, read them back, and resolve the revisits."""
    spark = pages.sparkSession
    index = write_archives(decide(pages, **options), scratch(spark, "warc"))
    return resolve(read_archives(spark, index))
