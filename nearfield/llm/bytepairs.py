"""Byte-level token ids of whole texts from a file of ranks, and the bytes of ids.

General over ``doc_id, text``: the library's own records hold vectors, ids and
metrics, no running text to encode.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from nearfield.llm.common import blobs, slices, text_rows

#: Texts above so many characters are encoded part by part.
PART_CHARS = 1 << 16
# Where the splitting pattern of a byte-level vocabulary always ends a match: before
# a space or line break that follows anything but white space, after an ASCII letter
# that no letter follows, after an ASCII digit that no digit follows. Characters
# beyond ASCII are left to the library, whatever Unicode version it knows.
_SAFE = regex.compile(
    r"(?<=\S)(?<![\x1c-\x1f])(?=[ \n])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])"
)
_ENCODINGS: dict[tuple, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks: one base64 text and one number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(path: str, pattern: str):
    """The encoding of a file of ranks, kept for later batches of this Python worker."""
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}
        )
    return _ENCODINGS[path, pattern]


def safe_parts(text: str, limit: int = PART_CHARS):
    """Cut a text where a match of the pattern ends in any case, after ``limit`` characters or more.

    The parts' ids in a row are those of the text. A run without such a place
    stays whole, however long it is.
    """
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, limit: int = PART_CHARS) -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of every whole text, 32-bit little-endian, unsigned.

    Every match of ``pattern`` is encoded on its own and no special tokens are
    looked for, so their spellings are ordinary text. Null and empty texts have
    no ids. One row per row given, ids repeated or null as they are; other
    columns are ignored, and an empty table gives an empty one. A task holds
    the ids of a few texts at a time.
    """

    def encode(batches):
        coder = encoding(ranks, pattern)
        for batch in batches:
            for rows in slices(batch):
                coded = []
                for text in blobs(rows):
                    ids: list[int] = []
                    for part in safe_parts(text.decode("utf-8", "replace"), limit):
                        ids += coder.encode_ordinary(part)
                    coded.append(np.array(ids, "<u4"))
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        pa.array([len(ids) for ids in coded], pa.int64()),
                        pa.array([ids.tobytes() for ids in coded], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return text_rows(docs).mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary")


def decode_ids(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The given rows with ``data``, the bytes that ``ids`` stand for.

    The bytes are put together as they are: ids that were cut in the middle of
    a character decode to a part of it. Null ids give null, an id that the file
    does not have raises an error. A column ``data`` is replaced.
    """
    rows = rows.drop("data")
    names = rows.columns

    def decode(batches):
        coder = encoding(ranks, pattern)
        for batch in batches:
            for part in slices(batch):
                data = [
                    None if ids is None else coder.decode_bytes(np.frombuffer(ids, "<u4").tolist())
                    for ids in blobs(part, "ids")
                ]
                yield pa.record_batch([*part.columns, pa.array(data, pa.binary())], names=[*names, "data"])

    schema = T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(decode, schema)
