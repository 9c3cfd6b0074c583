"""Deduplicated WARC archives of pages, with revisit records for repeated payloads.

General over ``page_id, url, html``: the library's own records hold no pages.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.runtime import hot_key_join, materialize

END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_digest string, "
    "payload_bytes bigint, refers_to bigint"
)


def _payload():
    return F.coalesce("html", F.lit(""))


def payload_headers(pages: DataFrame) -> DataFrame:
    """``page_id, payload_digest, payload_bytes`` of every page (null html: empty)."""
    return pages.select(
        "page_id",
        F.sha2(_payload().cast("binary"), 256).alias("payload_digest"),
        F.octet_length(_payload()).cast("bigint").alias("payload_bytes"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the records that revisit another.

    Of records with equal digests and at least ``min_bytes`` the one with the
    smallest ``page_id`` is the response. Rows that repeat that ``page_id`` are
    responses too; a null ``page_id`` never is where another page has one.
    Only headers are shuffled, summed before the shuffle; a digest with very
    many pages is joined in slices.
    """
    large = headers.filter(F.col("payload_bytes") >= min_bytes)
    first = (
        large.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1 and refers_to is not null")
        .drop("_n")
    )
    revisits = hot_key_join(large, first, ["payload_digest"], "page_id")
    return (
        revisits.filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def _record_id(page_id):
    """A URN made of the page and its digest, so that a retried task writes the same one."""
    digest = F.md5(F.concat_ws(":", page_id.cast("string"), F.col("payload_digest")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, *c) for c in cuts]), F.lit(">")
    )


def _line(name: str, value):
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def warc_records(pages: DataFrame, date: str, min_bytes: int = 100) -> DataFrame:
    """One column ``value``: the text of every page's record, without its final blank lines.

    A response holds an HTTP header and the payload, a revisit the HTTP header
    alone. Line breaks in ``url`` become spaces.
    """
    headers = materialize(payload_headers(pages), "payload-headers")
    revisits = resolve_revisits(headers, min_bytes).withColumnsRenamed(
        {"page_id": "_page", "payload_digest": "_digest"}
    )
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("_body"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("_body").cast("binary"), 256)).join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")),
        "left",
    )
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("_body")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_body")))
    rows = rows.withColumn("_block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "),
                _record_id(F.col("refers_to")),
                F.lit("\r\n"),
            ),
        ).otherwise(F.lit("")),
        _line("Page-Id", F.col("page_id")),
        _line("Refers-To-Page-Id", F.col("refers_to")),
        _line("Payload-Length", size),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(head, "_block").alias("value"))


def write_archives(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 100
) -> None:
    """Write the pages as gzipped WARC archives under ``path``, one file per partition.

    An empty table writes archives without records.
    """
    (
        warc_records(pages, date, min_bytes)
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .text(path)
    )


def _parse(buffer: bytearray):
    """Take whole records off the buffer: (header dict, block)."""
    found, at = [], 0
    end = END.encode()
    while True:
        head = buffer.find(end, at)
        if head < 0:
            break
        if head == at:
            # A file that ends in a line break and a separator is cut at the first
            # separator; the rest is a piece too, and got one that is not in the file.
            at += len(end)
            continue
        lines = bytes(buffer[at:head]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {lines[0][:80]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = head + len(end), int(fields["Content-Length"])
        if len(buffer) < start + size + len(end):
            break
        found.append((fields, bytes(buffer[start : start + size])))
        at = start + size + len(end)
    del buffer[:at]
    return found


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives that ``write_archives`` wrote.

    Columns of ``RECORD_SCHEMA`` and, unless left out, ``payload`` (null for
    revisits, which hold none). Blocks are cut by their stated length, so a
    payload may contain anything, record separators too. A gzipped archive is
    one task's stream; a task holds one record at a time. A response whose
    payload does not match its digest or length raises an error.
    """
    end = END.encode()
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary"))
    names = [c.strip().split()[0] for c in RECORD_SCHEMA.split(",")]

    def row(fields, block):
        kind = fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(fields["Payload-Length"])
        payload = block[block.index(end) + len(end) :] if kind == "response" else None
        if payload is not None and (
            len(payload) != size or hashlib.sha256(payload).hexdigest() != digest
        ):
            raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
        ids = [int(fields[n]) if n in fields else None for n in ("Page-Id", "Refers-To-Page-Id")]
        return ids[0], fields.get("WARC-Target-URI"), kind, digest, size, ids[1], payload

    def run(batches):
        buffer = bytearray()
        for batch in batches:
            rows = []
            for piece in batch.column(0):
                buffer += piece.as_buffer()
                buffer += end
                if len(buffer) > 1 << 16:
                    rows += [row(*r) for r in _parse(buffer)]
                    if len(rows) >= 256:
                        yield table(rows)
                        rows = []
            rows += [row(*r) for r in _parse(buffer)]
            if rows:
                yield table(rows)
        if buffer:
            raise ValueError("the archive ends inside a record")

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def table(rows):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        keep = 7 if payloads else 6
        return pa.record_batch(columns[:keep], names=(names + ["payload"])[:keep])

    schema = RECORD_SCHEMA + (", payload binary" if payloads else "")
    return pieces.mapInArrow(run, schema)
