"""Word splitting, bounded word caches and small table helpers of the llm operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of an Arrow batch that a task turns into Python objects at a time.
SLICE = 256


def text_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns in ``keep`` and the text as UTF-8 bytes (null: empty) in ``_text``.

    Every other column is dropped, so columns with clashing names do no harm.
    """
    return docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).cast("binary").alias("_text"))


def slices(batch: pa.RecordBatch, rows: int = SLICE):
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def blobs(batch: pa.RecordBatch, name: str = "_text") -> list[bytes]:
    return batch.column(name).to_pylist()


_LAST: list[dict] = []


def kept(cache: dict, key, make):
    """``cache[key]``, made where it is missing, for later tasks of this Python worker.

    Workers outlive a stage. The cache that another operator used last is
    emptied, so that the words of all stages never lie side by side.
    """
    if _LAST and _LAST[0] is not cache:
        _LAST.pop().clear()
    if not _LAST:
        _LAST.append(cache)
    if key not in cache:
        cache[key] = make(key)
    return cache[key]


class WordTable(dict):
    """Numbers for words, with one computed record for each; emptied above ``limit`` words.

    ``learn(words)`` returns one record per new word. Tasks call ``prepare``
    before each bounded set of texts; numbers stay valid until its next call.
    """

    def __init__(self, learn, limit: int = 300_000):
        super().__init__()
        self.learn, self.limit = learn, limit
        self.clear_all()

    def clear_all(self):
        self.clear()
        self.columns = None
        self.used = 0

    def prepare(self, texts: list[list[bytes]]) -> list[list[bytes]]:
        """Learn the new words of some split texts together; returns the texts."""
        if len(self) > self.limit:
            self.clear_all()
        fresh = [w for w in set().union(*texts) if w not in self]
        if fresh:
            self._append(self.learn(fresh), len(fresh))
            self.update(zip(fresh, range(self.used - len(fresh), self.used)))
        return texts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of every word, all of them prepared."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def _append(self, columns: tuple, count: int) -> None:
        need = self.used + count
        if self.columns is None:
            self.columns = [np.zeros(max(1024, need), c.dtype) for c in columns]
        if need > len(self.columns[0]):
            self.columns = [
                np.concatenate([c, np.zeros(max(need, 2 * len(c)) - len(c), c.dtype)])
                for c in self.columns
            ]
        for mine, new in zip(self.columns, columns):
            mine[self.used : need] = new
        self.used = need


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of every segment ``offsets[i]:offsets[i + 1]``, zero for empty ones."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add."""
    return df.drop(*[n for n in names if n in df.columns])


def bernoulli(seed: int, key: str):
    """A number in [0, 1) that depends on the seed and the key column alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
