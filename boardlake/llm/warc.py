"""WARC archives: written with segmented records and chunked bodies, read back and reassembled.

Writing: each page becomes one record whose block is an HTTP response in chunked transfer
framing. Blocks above ``segment_bytes`` are cut: the first piece is the response record with
segment number 1, the others are continuation records that name its id, their number and, on
the last one, the total length. Of pages with equal payloads of at least ``min_revisit_bytes``
the smallest page_id keeps the payload, the others become revisit records without a body.
Spark's text writer ends every record with the two line ends the format asks for, so any store
Spark can write is fine; files hold a bounded number of bounded records.

Reading: files are parsed by Content-Length, never by searching for a separator. Records of one
piece are decoded where they are. Pieces of longer ones are grouped by origin id, ordered by
segment number, checked against the total length and joined; a group is one page.

Defined cases: a null html is an empty payload; a page without page_id is written without one
and, when its payload is shared with a numbered page, revisits that page. Repeated rows give
one record each (rows repeating the first page_id are responses too). A file that breaks off, a
missing piece or a wrong length is an error, never a shorter payload. No pages: no archives and
an empty result.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, saved

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 2048
MIN_REVISIT_BYTES = 100
END = b"\r\n"
RECORD = "page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long, record_id string, origin string, number int, total long, block binary"


def with_first(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, its digest and, for repeats, the page_id that keeps the payload."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.length("payload") >= min_bytes).groupBy(F.col("digest").alias("_d"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    )
    # Written once, so that both sides of the join are shuffled and a hot payload can be split.
    joined = rows.join(saved(shared.select("_d", "_first"), "warc-shared"), F.col("digest") == F.col("_d"), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.length("payload").cast("bigint").alias("size"), "digest", refers.alias("refers_to"))


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        out += [b"%x" % len(piece), END, piece, END]
    return b"".join([*out, b"0", END, END])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; sizes may carry extensions, trailers may follow."""
    out, at = [], 0
    while True:
        stop = body.index(END, at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("A chunk does not end where its size says.")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(page_id, url, payload, size, digest, refers_to, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    urn = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    where = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", where), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", size),
    ]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
        yield _record([*fields, ("Content-Type", "application/http;msgtype=response")], status + END)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http;msgtype=response")
    if len(block) <= segment_bytes:
        yield _record([*fields, kind], block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1), kind], block[:segment_bytes])
    count = -(-len(block) // segment_bytes)
    for k in range(1, count):
        yield _record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", urn), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", len(block) if k == count - 1 else None),
        ], block[k * segment_bytes : (k + 1) * segment_bytes])


def write_archives(pages: DataFrame, path: str, *, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files below ``path``."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            found, held = [], 0
            for page_id, url, payload, size, digest, refers in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                row += 1
                page = None if page_id is None else int(page_id)
                for record in page_records(page, url, payload, size, digest, None if refers is None else int(refers), f"{part}/{row}/{page}/{digest}", segment_bytes):
                    found.append(record)
                    held += len(record)
                if held > 8_000_000:
                    yield pd.DataFrame({"record": found})
                    found, held = [], 0
            yield pd.DataFrame({"record": found})

    rows = with_first(pages, min_revisit_bytes).mapInPandas(records, "record binary")
    (
        rows.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or stop < 0:
            raise ValueError("A WARC record does not begin where the one before it ends.")
        lines = data[at:stop].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        size = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        at = stop + 8 + size
        if len(block) != size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("A WARC record is shorter or longer than it says.")
        yield head, block


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives below ``path``, one row each."""

    def number(head: dict[str, str], name: str):
        return int(head[name]) if name in head else None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        whole = ("page_id", "refers_to", "payload_bytes", "number", "total")
        for batch in batches:
            for data in batch["content"]:
                found, held = [], 0
                for head, block in parsed(gzip.decompress(data)):
                    found.append((
                        number(head, "x-page-id"), head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        number(head, "x-refers-to-page-id"), number(head, "x-payload-length"), head["warc-record-id"],
                        head.get("warc-segment-origin-id"), number(head, "warc-segment-number"), number(head, "warc-segment-total-length"), block,
                    ))
                    held += len(block)
                    if held > 8_000_000:
                        yield pd.DataFrame(found, columns=names).astype({c: "Int64" for c in whole})
                        found, held = [], 0
                yield pd.DataFrame(found, columns=names).astype({c: "Int64" for c in whole})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(rows, RECORD)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes and payload (null for revisits)."""
    records = read_records(spark, path)
    keep = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    piece = F.array(F.struct(F.coalesce("number", F.lit(1)).alias("number"), "block"))
    single = records.where("number is null").select(*keep, F.length("block").cast("bigint").alias("total"), piece.alias("pieces"))
    # Only pages cut into pieces are shuffled.
    groups = records.where("number is not null").groupBy(F.coalesce("origin", "record_id").alias("origin"))
    first = [F.max_by(c, (F.col("record_type") == "response").cast("int")).alias(c) for c in keep]
    joined = groups.agg(*first, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("pieces"))

    def payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, total, pieces in zip(batch["record_type"], batch["total"], batch["pieces"]):
                numbers = [p["number"] for p in pieces]
                block = b"".join(bytes(p["block"]) for p in pieces)
                if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
                    raise ValueError("Segments of a record are missing or its total length is wrong.")
                head, _, body = block.partition(b"\r\n\r\n")
                framed = b"transfer-encoding: chunked" in head.lower()
                out.append(None if kind == "revisit" else unchunked(body) if framed else body)
            yield batch[keep].assign(payload=out)

    schema = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return single.unionByName(joined.select(*single.columns)).mapInPandas(payloads, schema)


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **settings)
    return read_archives(pages.sparkSession, path)
