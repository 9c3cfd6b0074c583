"""Token ids as Parquet list columns, written in document order and read selectively.

The operator works on texts (``doc_id, text``). The library's own records hold
vectors and edges but no text, so it is general; integer list columns such as
``ivecs`` rows can be written with ``write_lists`` alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from nearfield.llm.common import blobs, offsets_of, slices, text_rows
from nearfield.llm.encoding import coder

ID_SCHEMA = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>"


def encode_ids(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Ids of every whole text with ``end_id`` appended, in ascending ``doc_id`` order.

    Null and empty texts give the end id alone. Rows with a null ``doc_id``
    come first; rows that share a ``doc_id`` are ordered by text. Each row has
    the partition it was written by (``part``) and the number of ids before it
    there (``part_start``), so that a global position needs one sum per part.
    An empty table gives an empty table; other columns are ignored.
    """
    rows = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, done = TaskContext.get().partitionId(), 0
        encoder = coder(vocabulary)
        for batch in batches:
            for rows in slices(batch):
                coded = [ids + tail for ids in encoder.encode_all(blobs(rows))]
                lengths = np.array([len(c) // 4 for c in coded], np.int64)
                offsets = offsets_of(lengths)
                values = np.frombuffer(b"".join(coded), "<i4")
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(coded), part, np.int32)),
                        rows.column("doc_id"),
                        pa.array(done + offsets[:-1]),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(offsets.astype(np.int32), values),
                    ],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                done += int(offsets[-1])

    return rows.mapInArrow(encode, ID_SCHEMA)


def write_lists(
    rows: DataFrame,
    path: str,
    ids: str = "ids",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
) -> None:
    """Write rows with an integer list column for selective reads.

    List values are dictionary encoded (small vocabularies pack into two bytes
    or less), all other columns delta encoded. Row groups are small and pages
    are cut by bytes and rows, with the column and offset index that Parquet
    keeps per page: a filter on a sorted column reads only the pages it needs,
    and a read without the list column never touches it.
    """
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        f"parquet.enable.dictionary#{ids}.list.element": "true",
    }
    rows.write.options(**options).parquet(path)


def read_ids(spark: SparkSession, path: str, doc_ids=None, ids: bool = True) -> DataFrame:
    """The written rows: ``doc_id, start, n_tokens`` and, unless left out, ``ids``.

    ``start`` counts the ids of all documents before. ``doc_ids`` is an optional
    pair of bounds (first, last) that is pushed down to row groups and pages.
    """
    table = spark.read.schema(ID_SCHEMA).parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per writing task, whatever the number of documents.
    firsts = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if doc_ids is not None:
        table = table.filter(F.col("doc_id").between(*doc_ids))
    columns = ["doc_id", (F.col("_first") + F.col("part_start")).alias("start"), "n_tokens"]
    return table.join(F.broadcast(firsts), "part").select(*columns, *(["ids"] if ids else []))


def with_crc(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` with the unsigned crc32 of the ids as 32-bit little-endian."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            kept = [batch.column(n) for n in ("doc_id", "start", "n_tokens")]
            yield pa.record_batch(
                [*kept, pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, schema)
