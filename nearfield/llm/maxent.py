"""A hashed maximum-entropy language model with a class-factored softmax.

General over ``doc_id, text``: the library's own records hold no texts.

The probability of a token is P(class | history) * P(token | class). Classes
come from the token itself (the most frequent tokens have one each, the others
share one by the hash of their ending), so that they need no table. The first
factor is a softmax over hashed features of the history: the token before, the
pair before, and the token that one is skipped to; the second is the token's
smoothed share of its class. Unseen tokens have the share of one unseen token.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import blobs, offsets_of, segment_sums, slices, text_rows
from nearfield.runtime import materialize

#: The end of a text; no word is empty.
END = b""


@dataclass(frozen=True)
class MaxentParams:
    """``rounds`` synchronous updates, each over the texts of one share of the training data.

    ``slots`` weight rows for hashed features, ``classes`` columns, of which
    ``own_classes`` belong to the most frequent tokens. Counts of the
    ``frequent`` most frequent tokens are sent to the scoring tasks, all others
    are joined. ``step`` is the learning rate, ``batch`` the tokens of a local update.
    """

    slots: int = 1 << 13
    classes: int = 32
    own_classes: int = 12
    rounds: int = 3
    step: float = 0.15
    batch: int = 8192
    frequent: int = 100_000
    seed: int = 17


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text, lower-cased in A-Z, and the end."""
    words = text.lower().split()
    words.append(END)
    return words


class TokenClasses(dict):
    """``rank << 40 | hash << 8 | class`` by token, kept for up to ``limit`` tokens.

    The rank is that in ``frequent``, from 1, and 0 for all other tokens.
    """

    def __init__(self, own: list[bytes], params: MaxentParams, limit: int = 300_000, frequent=()):
        self.shared = params.classes - params.own_classes
        self.first = params.own_classes
        self.limit = limit
        self.ranks = {w: i for i, w in enumerate(frequent, 1)}
        self.own = {w: self.ranks.get(w, 0) << 40 | crc32(w) << 8 | i for i, w in enumerate(own)}
        super().__init__(self.own)

    def __missing__(self, word: bytes) -> int:
        ending = word.rstrip(b".,;:!?")[-3:]
        code = crc32(word) << 8 | self.first + crc32(ending) % self.shared
        rank = self.ranks.get(word)
        if rank:
            code |= rank << 40
        self[word] = code
        return code

    def coded(self, words: list[bytes]) -> np.ndarray:
        """The codes of some tokens; take them apart by ``hashes_of``, ``classes_of`` and ``ranks_of``."""
        if len(self) > self.limit:
            self.clear()
            self.update(self.own)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def hashes_of(coded: np.ndarray) -> np.ndarray:
    return coded >> 8 & 0xFFFFFFFF


def classes_of(coded: np.ndarray) -> np.ndarray:
    return coded & 255


def ranks_of(coded: np.ndarray) -> np.ndarray:
    return coded >> 40


def history_slots(hashes: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """Slots of the three history features of every token; ``starts`` marks first tokens of texts."""
    n = len(hashes)
    position = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    h = hashes.astype(np.uint64)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = h[:-1] + np.uint64(1), h[:-2] + np.uint64(1)
    one[position < 1] = 0
    two[position < 2] = 0
    with np.errstate(over="ignore"):
        k = np.uint64(0x9E3779B97F4A7C15)
        found = np.stack([
            (one + np.uint64(1)) * k,
            ((one + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) + two) * k,
            (two + np.uint64(1 << 40)) * np.uint64(0xD6E8FEB86659FD93),
        ])
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xBF58476D1CE4E5B9)
    return ((found >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)


def _scores(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of every token and class, the largest of a token being 0."""
    z = weights.take(at[0], axis=0)
    for row in at[1:]:
        z += weights.take(row, axis=0)
    z += bias
    z -= _row_max(z)
    return z


def _row_max(z: np.ndarray) -> np.ndarray:
    """``z.max(axis=1, keepdims=True)``, halving the columns, which are few."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        top = np.maximum(z[:, :half], z[:, half : 2 * half])
        if z.shape[1] % 2:
            np.maximum(top[:, :1], z[:, -1:], out=top[:, :1])
        z = top
    return z


def _sums_of_runs(rows: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray, short: int = 8) -> np.ndarray:
    """``np.add.reduceat(rows[at], first)``; runs are ``size`` long and most are short.

    Short runs are added place by place, all of them together, in reduceat's order: the first
    row comes last.
    """
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    little = np.flatnonzero(size <= short)
    little = little[np.argsort(-size[little].astype(np.int8), kind="stable")]
    start, length = first[little], size[little]
    longer = [np.searchsorted(-length, -k) for k in range(short)]
    found = rows.take(at[start], axis=0)
    if longer[1]:
        more = rows.take(at[start[: longer[1]] + 1], axis=0)
        for k in range(2, short):
            if longer[k]:
                more[: longer[k]] += rows.take(at[start[: longer[k]] + k], axis=0)
        found[: longer[1]] += more
    out[little] = found
    large = np.flatnonzero(size > short)
    if len(large):
        length = size[large]
        ends = np.cumsum(length)
        place = np.repeat(first[large] - (ends - length), length) + np.arange(ends[-1])
        out[large] = np.add.reduceat(rows.take(at[place], axis=0), ends - length, axis=0)
    return out


def class_log_probs(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) for every token and class."""
    z = _scores(weights, bias, at)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def label_log_probs(weights: np.ndarray, bias: np.ndarray, at: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``class_log_probs`` of one class of every token."""
    z = _scores(weights, bias, at)
    own = z[np.arange(len(z)), label]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def token_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` (binary, bigint) of all tokens of ``_text``; tasks count first."""

    def count(batches):
        sums: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in blobs(part):
                    sums.update(tokens_of(text))
                if len(sums) > 200_000:
                    yield table(sums)
                    sums = Counter()
        if sums:
            yield table(sums)

    def table(sums):
        return pa.record_batch(
            [pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())],
            names=["word", "c"],
        )

    counted = texts.select("_text").mapInArrow(count, "word binary, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class MaxentModel:
    """What scoring needs besides the table of counts; its size does not grow with the data."""

    own: list[bytes]
    weights: np.ndarray
    bias: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    params: MaxentParams


def _class_sums(counts: DataFrame, own: list[bytes], params: MaxentParams):
    """Tokens and distinct tokens of every class."""

    def add(batches):
        classes = TokenClasses(own, params)
        sums = np.zeros((2, params.classes), np.int64)
        for batch in batches:
            at = classes_of(classes.coded(blobs(batch, "word")))
            n = batch.column("c").to_numpy()
            sums[0] += np.bincount(at, n, params.classes).astype(np.int64)
            sums[1] += np.bincount(at, minlength=params.classes)
        names = ["class", "tokens", "words"]
        yield pa.record_batch([pa.array(range(params.classes), pa.int32()), *map(pa.array, sums)], names=names)

    parts = counts.mapInArrow(add, "class int, tokens bigint, words bigint").groupBy("class")
    out = np.zeros((2, params.classes))
    for row in parts.agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect():
        out[:, row["class"]] = row["t"], row["w"]
    return out


def fit_maxent(training: DataFrame, counts: DataFrame, params: MaxentParams = MaxentParams()):
    """Train on ``doc_id, text`` rows; ``counts`` is their ``token_counts``.

    Every round starts all tasks from the same weights. A task runs over its
    texts of the round's share in local batches of gradient steps, scaled per
    weight by the squared gradients so far, and returns how the rows it touched
    moved; Spark averages the moves by the tokens behind them. All training
    texts are used once. A round gives the driver one row per weight slot.
    """
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(params.own_classes - 1)
    own = [END] + [bytes(r["word"]) for r in top.collect()]
    class_tokens, class_words = _class_sums(counts, own, params)
    size = class_tokens.sum()
    bias = np.log((class_tokens + 1) / (size + params.classes)).astype(np.float32)
    weights = np.zeros((params.slots, params.classes), np.float32)
    rows = text_rows(training)
    share = F.pmod(F.xxhash64(F.lit(params.seed), "doc_id"), F.lit(params.rounds))
    for number in range(params.rounds):
        weights = weights + _round(rows.filter(share == number), own, weights, bias, params)
    return MaxentModel(own, weights, bias, class_tokens, class_words, params)


def _round(rows: DataFrame, own, weights, bias, params: MaxentParams) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast((own, weights, bias))
    names = ["slot", "n", *(f"m{i}" for i in range(params.classes))]

    def train(batches):
        own, start, bias = shared.value
        weights = start.copy()
        squares = np.full(len(weights), 1e-4, np.float32)
        seen = np.zeros(len(weights), np.int64)
        classes = TokenClasses(own, params)
        pending, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for text in blobs(part):
                    pending.append(classes.coded(tokens_of(text)))
                    size += len(pending[-1])
                    if size >= params.batch:
                        step(weights, squares, seen, bias, pending)
                        pending, size = [], 0
        if pending:
            step(weights, squares, seen, bias, pending)
        touched = np.flatnonzero(seen)
        moves = (weights[touched] - start[touched]) * seen[touched, None]
        yield pa.record_batch(
            [pa.array(touched), pa.array(seen[touched]), *map(pa.array, moves.T.copy())], names=names
        )

    def step(weights, squares, seen, bias, pending):
        coded = np.concatenate(pending)
        starts = offsets_of([len(p) for p in pending])[:-1]
        at, label = history_slots(hashes_of(coded), starts, params.slots), classes_of(coded)
        for lo in range(0, len(coded), params.batch):
            part = at[:, lo : lo + params.batch]
            error = np.exp(class_log_probs(weights, bias, part))
            error[np.arange(len(error)), label[lo : lo + params.batch]] -= 1
            flat = part.ravel()
            order = np.argsort(flat.astype(np.min_scalar_type(params.slots)), kind="stable")
            ordered = flat[order]
            first = np.flatnonzero(np.diff(ordered, prepend=-1))
            slot, n = ordered[first], np.diff(first, append=len(ordered))
            gradient = _sums_of_runs(error, order % len(error), first, n) / np.sqrt(n)[:, None]
            squares[slot] += (gradient * gradient).mean(axis=1)
            weights[slot] -= params.step * gradient / np.sqrt(squares[slot])[:, None]
            seen[slot] += n

    schema = ", ".join(["slot bigint, n bigint", *(f"{m} double" for m in names[2:])])
    moved = rows.mapInArrow(train, schema)
    sums = [(F.sum(m) / F.sum("n")).alias(m) for m in names[2:]]
    table = moved.groupBy("slot").agg(*sums).toArrow()
    out = np.zeros_like(weights)
    out[table["slot"].to_numpy()] = np.stack([table[m].to_numpy() for m in names[2:]], axis=1)
    return out


def score_maxent(docs: DataFrame, counts: DataFrame, model: MaxentModel) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every whole text.

    ``score`` is the log10 probability of the text with its end, ``base_score``
    that of the add-one model of single tokens. Texts stay where they are: a
    task scores classes and frequent tokens, and lists a text's other tokens,
    whose counts are joined by token and summed by text.
    """
    params = model.params
    base = np.log10(model.class_tokens.sum() + model.class_words.sum() + 1)
    inside = np.log10(model.class_tokens + model.class_words + 1)
    top = counts.orderBy(F.desc("c"), "word").limit(params.frequent).toArrow()
    lowest = top["c"].to_numpy().min() if len(top) == params.frequent else 0
    # Rank 0 is that of all other tokens.
    frequent = top["word"].to_pylist(), np.append(-1.0, np.log10(top["c"].to_numpy() + 1))
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.own, model.weights, model.bias, frequent)
    )
    names = ["key", "doc_id", "n_tokens", "n_known", "_counted", "_classes", "rare"]

    def score(batches):
        own, weights, bias, (frequent, counted) = shared.value
        classes = TokenClasses(own, params, frequent=frequent)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 64):
                lists = [tokens_of(t) for t in blobs(part)]
                offsets = offsets_of([len(t) for t in lists])
                words = list(chain.from_iterable(lists))
                coded = classes.coded(words)
                at = history_slots(hashes_of(coded), offsets[:-1], params.slots)
                label = classes_of(coded)
                value = np.empty(len(coded))
                for lo in range(0, len(coded), params.batch):
                    step = slice(lo, lo + params.batch)
                    value[step] = label_log_probs(weights, bias, at[:, step], label[step])
                value = value / np.log(10) - inside[label]
                flat = counted[ranks_of(coded)]
                unseen = np.flatnonzero(flat < 0)
                # Where each text's rare tokens start among all of them.
                cuts = np.searchsorted(unseen, offsets)
                rare = pa.ListArray.from_arrays(
                    cuts.astype(np.int32), pa.array([words[i] for i in unseen.tolist()], pa.binary())
                )
                known = np.diff(offsets) - np.diff(cuts)
                yield pa.record_batch(
                    [
                        pa.array(key + np.arange(len(lists))),
                        part.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.array(known),
                        pa.array(segment_sums(np.maximum(flat, 0), offsets)),
                        pa.array(segment_sums(value, offsets)),
                        rare,
                    ],
                    names=names,
                )
                key += len(lists)

    schema = (
        "key bigint, doc_id bigint, n_tokens bigint, n_known bigint, _counted double, "
        "_classes double, rare array<binary>"
    )
    parts = materialize(text_rows(docs).mapInArrow(score, schema), "scored-texts")
    # A token outside the frequent ones has at most the count of the last of them.
    others = counts.filter(F.col("c") <= int(lowest)) if lowest else counts.limit(0)
    looked = parts.select("key", F.explode("rare").alias("word")).join(others, "word")
    looked = looked.groupBy("key").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("_more"), F.count(F.lit(1)).alias("_known")
    )
    counted = F.col("_counted") + F.coalesce("_more", F.lit(0.0))
    return parts.drop("rare").join(looked, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (counted - F.col("n_tokens") * F.lit(float(base))).alias("base_score"),
        (counted + F.col("_classes")).alias("score"),
    )


def language_model(docs: DataFrame, held_out, params: MaxentParams = MaxentParams()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Counts and weights are learnt from the rows where the column ``held_out``
    is not true. A null or empty text is its end alone. Repeated rows count
    each time; a table without training rows gives scores of an empty model,
    an empty table an empty table.
    """
    rows = docs.select("doc_id", "text", held_out.alias("_held_out"))
    training = rows.filter(~F.coalesce("_held_out", F.lit(False)))
    counts = materialize(token_counts(text_rows(training)), "token-counts")
    model = fit_maxent(training, counts, params)
    scored = score_maxent(docs, counts, model)
    total = int(model.class_tokens.sum())
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
