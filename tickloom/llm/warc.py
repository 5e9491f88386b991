"""WARC archives: pages written as segmented, chunked records, and read back whole.

A payload goes into an HTTP response with chunked transfer framing.  A block longer than
``SEGMENT`` bytes becomes a record and continuation records; the reader groups them by the
identifier of their origin, orders them by segment number, checks the total length that the
last one states, and decodes the framing.  Of equal payloads one record holds the bytes and
the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.staging import join_hot, new_path, staged

SEGMENT = 16 << 10
CHUNK = 8 << 10
#: Fixed by the format: the version line opens a record, an empty line and another close it.
VERSION = b"WARC/1.1\r\n"
#: What all versions that are read, 1.0 and 1.1, begin with.
SEPARATOR = b"WARC/1."
READ_VERSIONS = (b"0\r\n", b"1\r\n")
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = (
    "record_id string, kind string, page_id long, url string, refers string, origin string, segment int, "
    "total long, digest string, block binary"
)
NAMES = ["record_id", "kind", "page_id", "url", "refers", "origin", "segment", "total", "digest", "block"]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}').urn}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The bytes inside chunked framing; a body cut short is an error."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = line + 2
        if len(body) < at + size + 2:
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the empty lines that close it."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return VERSION + "\r\n".join(lines).encode() + END + block


def _written(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                digest = payload_digest(payload)
                own = _record_id(page_id, digest)
                head = [
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("X-Page-Id", page_id),
                ]
                if first is not None and first != page_id:
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", _record_id(first, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    out.append(_record([*fields, *head], b""))
                    continue
                block = HTTP + chunked(payload)
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
                out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", own), number, *head], parts[0]))
                for i, part in enumerate(parts[1:], 2):
                    fields = [
                        ("WARC-Type", "continuation"),
                        ("WARC-Record-ID", _record_id(page_id, f"{digest}/{i}")),
                        ("WARC-Segment-Origin-ID", own),
                        ("WARC-Segment-Number", i),
                        ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None),
                        ("WARC-Date", DATE),
                    ]
                    out.append(_record(fields, part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_warc(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Archives of ``pages(page_id, url, html)`` below ``path``, gzipped, one for each task.

    Of equal payloads of at least ``least`` bytes the one with the smallest ``page_id`` is a
    response and the others revisit it; rows that repeat the smallest id are responses too.  Rows
    without ``page_id`` come last, and are responses if all rows of a payload lack one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha1("payload")
    repeated = staged(
        rows.where(F.octet_length("payload") >= least)
        .groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "payloads",
    )
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, digest)).withColumn("key", F.coalesce(F.xxhash64("page_id"), F.lit(0)))
    records = join_hot(rows, repeated, "digest", "key").select("page_id", "url", "payload", "first").mapInArrow(_written(segment), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").text(path, lineSep=END.decode())


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces between versions; a block that holds what looks like one is joined again."""
    held, where = b"", None
    for batch in batches:
        rows = []
        for piece, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
            if file != where:
                if held.strip():
                    raise ValueError(f"{where}: the last record is cut short")
                held, where = b"", file
            if not held and piece.strip() and not piece.startswith(READ_VERSIONS):
                raise ValueError(f"{file}: not a record of WARC 1.0 or 1.1")
            held = held + SEPARATOR + piece if held else piece
            end = held.find(END)
            if end < 0:
                held = held if held.strip() else b""
                continue
            f = _fields(held[:end])
            block = held[end + 4 : end + 4 + int(f["content-length"])]
            if len(block) < int(f["content-length"]):
                continue
            if held[end + 4 + len(block) :].strip():
                raise ValueError(f"{file}: bytes between two records")
            held = b""
            kind, own = f["warc-type"], f.get("warc-record-id")
            if kind not in ("response", "revisit", "continuation"):
                continue
            number, page, total = (f.get(k) for k in ("warc-segment-number", "x-page-id", "warc-segment-total-length"))
            rows.append(
                (
                    own,
                    kind,
                    None if page is None else int(page),
                    f.get("warc-target-uri"),
                    f.get("warc-refers-to"),
                    f.get("warc-segment-origin-id", own),
                    None if number is None else int(number),
                    None if total is None else int(total),
                    f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    block,
                )
            )
        columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)
    if held.strip():
        raise ValueError(f"{where}: the last record is cut short")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = []
        for block in batch.column("block").to_pylist():
            head, _, body = block.partition(END)
            coded = _fields(head).get("transfer-encoding", "").lower() == "chunked"
            payloads.append(dechunked(body) if coded else body)
        keep = [n for n in NAMES if n != "block"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(payloads, pa.binary()), pa.array([payload_digest(p) for p in payloads], pa.string())],
            names=[*keep, "payload", "found"],
        )


def read_warc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The responses with whole payloads, and the revisits, of all archives below ``path``.

    Pieces between version lines are read as a stream, so an archive of any size takes the memory
    of one record.  Versions 1.0 and 1.1 are read; anything else between two records, segments that are missing or of another total length, and payloads with
    another digest than stated, fail the read.  Archives that are not compressed must be read
    unsplit.
    """
    pieces = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    records = pieces.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file")).mapInArrow(_parsed, RECORD)
    parts = (
        records.where("segment is not null")
        .groupBy("origin", "segment")
        .agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("record_id", "page_id", "url", "total", "digest", "block")), F.count("*").alias("times"))
    )
    joined = (
        parts.groupBy("origin")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("url").alias("url"),
            F.max("total").alias("total"),
            F.max("digest").alias("digest"),
            F.count("*").alias("n"),
            F.max("segment").alias("last"),
            F.min("times").alias("times"),
            F.transform(F.array_sort(F.collect_list(F.struct("segment", "block"))), lambda x: x["block"]).alias("blocks"),
        )
        .withColumn("block", F.concat(*[F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b))]))
    )
    whole = (F.col("n") == F.col("last")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    joined = joined.withColumn(
        "block", F.when(whole, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "origin")).cast("binary"))
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    joined = joined.select(
        F.col("origin").alias("record_id"), F.lit("response").alias("kind"), "page_id", "url", F.lit(None).cast("string").alias("refers"),
        "origin", F.lit(None).cast("int").alias("segment"), "total", "digest", "block",
    )
    decoded = f"{RECORD.removesuffix('block binary')}payload binary, found string"
    responses = records.where("kind = 'response' and segment is null").unionByName(joined).mapInArrow(_decoded, decoded)
    agree = F.col("digest").isNull() | (F.col("digest") == F.col("found"))
    responses = responses.withColumn(
        "payload", F.when(agree, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("wrong digest of "), "record_id")).cast("binary"))
    )
    return responses.select("record_id", "page_id", "url", F.col("found").alias("digest"), "payload"), records.where("kind = 'revisit'").select(
        "record_id", "page_id", "url", "refers", "digest"
    )


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from archives written and read back.

    Null html is an empty payload.  Repeated rows are records of their own.  Columns other than
    page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least)
    responses, revisits = read_warc(spark, path)
    sizes = responses.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "digest")
    own = sizes.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = sizes.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes").dropDuplicates(["refers"])
    again = join_hot(revisits.withColumn("spread", F.coalesce("page_id", F.lit(0))), target, "refers", "spread")
    again = again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return own.unionByName(again)
