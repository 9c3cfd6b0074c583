"""Packing examples into training sequences as vector bin packing.

An example uses three limited things at once: tokens, one segment, and
loss-bearing tokens. The operator is general over ``doc_id, text``: the
library's own records hold no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import blobs, slices
from nearfield.llm.encoding import coder

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, loss_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)
_NAMES = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most; ``tokens`` is a power of two."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if self.tokens < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("tokens must be a power of two")
        if self.segments < 1 or self.loss < 1:
            raise ValueError("segments and loss must be positive")


class _Packer:
    """Greedy packing of a bounded pool of examples of one task."""

    def __init__(self, limits: Limits, first_sequence: int, pool: int):
        self.limits, self.sequence, self.pool = limits, first_sequence, pool
        self.docs: list = []
        self.at = np.zeros(0, np.int64)
        self.left = np.zeros(0, np.int64)
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes, prompt: int) -> None:
        """Cut off full sequences and pool what is left."""
        n, at, cap = len(ids) // 4, 0, self.limits.tokens
        while n - at >= cap and self._loss(at, at + cap, prompt) <= self.limits.loss:
            self._place((doc_id, ids, n, prompt), at, cap, 0)
            self.sequence += 1
            at += cap
        if at < n:
            self.docs.append((doc_id, ids, n, prompt))
            self.at = np.append(self.at, at)
            self.left = np.append(self.left, n - at)

    @staticmethod
    def _loss(start, end, prompt):
        """Tokens in ``start:end`` that bear loss: those after the prompt."""
        return np.maximum(0, end - np.maximum(start, prompt))

    def _place(self, doc, start, length, offset) -> None:
        doc_id, ids, n, prompt = doc
        loss = int(self._loss(start, start + length, prompt))
        piece = ids[4 * start : 4 * (start + length)]
        self.out.append((doc_id, start, length, n, loss, self.sequence, offset, piece))

    def pack(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` examples are left in the pool."""
        prompts = np.array([d[3] for d in self.docs], np.int64)
        live = np.ones(len(self.docs), bool)
        count, total = len(self.docs), int(self.left.sum())
        while count > keep:
            # A last, smaller sequence has a power of two of tokens and needs no padding.
            size = min(self.limits.tokens, 1 << (total.bit_length() - 1))
            room = np.array([size, self.limits.segments, self.limits.loss], np.int64)
            loss = self._loss(self.at, self.at + self.left, prompts)
            offset = 0
            while room.min() > 0 and count:
                i, take = self._choose(live, loss, room, prompts)
                if take < 1:
                    break
                self._place(self.docs[i], int(self.at[i]), take, offset)
                used = int(self._loss(self.at[i], self.at[i] + take, prompts[i]))
                offset += take
                total -= take
                room -= (take, 1, used)
                self.at[i] += take
                self.left[i] -= take
                loss[i] -= used
                if not self.left[i]:
                    live[i] = False
                    count -= 1
            self.sequence += 1
        stay = np.flatnonzero(live)
        self.docs = [self.docs[i] for i in stay]
        self.at, self.left = self.at[stay], self.left[stay]

    def _choose(self, live, loss, room, prompts) -> tuple[int, int]:
        """The example whose needs have the largest dot product with the room that is left.

        Where none fits whole, or one last segment would leave tokens unused,
        an example that is too large is cut to what fits.
        """
        fits = live & (self.left <= room[0]) & (loss <= room[2])
        if room[1] == 1:
            exact = live & (self.left >= room[0])
            if exact.any():
                fits &= exact
        if fits.any():
            top = self.limits
            weight = room / np.array([top.tokens, top.segments, top.loss], float)
            score = self.left / top.tokens * weight[0] + weight[1] / top.segments
            score = score + loss / top.loss * weight[2]
            i = int(np.argmax(np.where(fits, score, -1.0)))
            return i, int(self.left[i])
        spare = np.minimum(self.left, room[0])
        free = np.maximum(0, prompts - self.at)
        spare = np.where(live, np.minimum(spare, free + room[2]), 0)
        i = int(np.argmax(spare))
        return i, int(spare[i])

    def flush(self):
        rows, self.out = self.out, []
        columns = list(zip(*rows))
        types = [pa.int64()] * 7 + [pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def pack(
    docs: DataFrame,
    vocabulary: str,
    limits: Limits = Limits(),
    end_id: int = 1,
    prompt_tokens: str | None = None,
    pool: int = 1024,
) -> DataFrame:
    """Pieces of all texts, placed in sequences that keep every limit.

    A text's ids end with ``end_id``; a null text is empty. ``prompt_tokens``
    names a column with the number of leading ids that bear no loss (null: 0).
    Full sequences are cut off long texts; of the rest, the piece is placed
    next whose (tokens, segments, loss tokens) have the largest dot product
    with the room left in the open sequence. Each id lies in one piece, and a
    task's last tokens go into sequences of a power of two.

    Nothing is shuffled: a task packs the rows it reads, with at most ``pool``
    open examples, so a retried task gives the same pieces. ``sequence_id`` is
    the task's number times 2^33 plus its sequences so far. Rows that share a
    ``doc_id``, or have none, are separate examples; an empty table gives none.
    Columns: doc_id, start, length, doc_tokens, loss_tokens, sequence_id,
    offset, ids (the piece, little-endian unsigned 32-bit).
    """
    prompt = F.lit(0) if prompt_tokens is None else F.coalesce(prompt_tokens, F.lit(0))
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).cast("binary").alias("_text"),
        prompt.cast("bigint").alias("_prompt"),
    )
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = coder(vocabulary)
        packer = _Packer(limits, TaskContext.get().partitionId() << 33, pool)
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(n).to_pylist() for n in ("doc_id", "_prompt")]
                for doc_id, prompt, ids in zip(*columns, encoder.encode_all(blobs(part))):
                    packer.add(doc_id, ids + tail, prompt)
                if len(packer.docs) > packer.pool:
                    packer.pack(packer.pool // 2)
                if packer.out:
                    yield packer.flush()
        packer.pack(0)
        if packer.out:
            yield packer.flush()

    return rows.mapInArrow(run, PIECE_SCHEMA)
