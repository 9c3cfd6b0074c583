"""A toxicity classifier whose scores do not depend on which group a text names.

General over ``doc_id, text`` and labels ``doc_id, toxic``: the library's own
records hold no texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import WordTable, blobs, slices, text_rows

_MARKS = b".,;:!?\"'()[]{}<>*#$%&|"

# Groups of identity terms; a term is swapped with the others of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
)


@dataclass(frozen=True)
class ToxicityParams:
    """At most ``label_limit`` labelled rows are fitted, on at most ``features`` hashed features.

    ``min_docs`` and ``min_z`` choose features by the difference of their
    shares in toxic and other rows; ``fairness`` weighs the counterfactual penalty.
    """

    bits: int = 20
    label_limit: int = 40_000
    features: int = 4096
    min_docs: int = 3
    min_z: float = 3.0
    l2: float = 1e-4
    fairness: float = 1.0
    steps: int = 300


class Hasher:
    """Features of a text: its words without outer marks, and their first four and five bytes."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.table = WordTable(self.learn)

    def word(self, word: bytes) -> tuple[int, int, int]:
        bare = word.strip(_MARKS) or word
        crc = zlib.crc32
        return tuple(x & self.mask for x in (crc(bare), crc(b"4" + bare[:4]), crc(b"5" + bare[:5])))

    def learn(self, words):
        found = np.array([self.word(w) for w in words], np.int64).reshape(-1, 3)
        return tuple(found.T)

    def texts(self, texts: list[bytes]):
        """Distinct features of each lower-cased text."""
        for words in self.table.prepare([t.split() for t in texts]):
            numbers = np.unique(self.table.numbers(words))
            if len(numbers):
                yield np.unique(np.concatenate([c[numbers] for c in self.table.columns]))
            else:
                yield np.zeros(0, np.int64)


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``_text, toxic`` of at most ``limit`` labelled documents, chosen in hash order."""
    once = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    once = once.agg(F.max("toxic").alias("toxic"))
    # At most label_limit rows of two columns.
    sample = F.broadcast(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return _lowered(docs).join(sample, "doc_id").select("_text", "toxic")


def _lowered(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", F.lower("text").alias("text"))
    return text_rows(docs)


@dataclass
class ToxicityModel:
    bits: int
    weights: np.ndarray
    bias: float


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    params: ToxicityParams = ToxicityParams(),
    identity_terms=IDENTITY_TERMS,
) -> ToxicityModel:
    """Logistic regression with a penalty on score changes under swapped identity terms.

    Two passes over the labelled rows: feature counts by label choose the
    features, then each row's chosen features and identity terms come to the
    driver, bounded by ``label_limit`` rows. For each training row and identity
    term in it, the swaps against the other terms of the group add
    ``fairness * (change of the linear score)^2``. Without labels of both kinds
    the model is a constant.
    """
    rows = labelled_rows(docs, labels, params.label_limit)
    size = 1 << params.bits

    def count(batches):
        hasher, sums = Hasher(params.bits), np.zeros((2, size), np.int64)
        for batch in batches:
            for part in slices(batch):
                for found, toxic in zip(hasher.texts(blobs(part)), part.column("toxic").to_pylist()):
                    sums[int(toxic == 1)][found] += 1
        seen = np.flatnonzero(sums.sum(axis=0))
        yield pa.record_batch(
            [pa.array(seen), pa.array(sums[0][seen]), pa.array(sums[1][seen])],
            names=["feature", "clean", "toxic"],
        )

    kinds = {bool(r[0]): r[1] for r in rows.groupBy(F.col("toxic") == 1).count().collect()}
    bad, good = kinds.get(True, 0), kinds.get(False, 0)
    bias = float(np.log((bad + 0.5) / (good + 0.5)))
    if not bad or not good:
        return ToxicityModel(params.bits, np.zeros(size, np.float32), bias)
    total = F.col("clean") + F.col("toxic")
    p, q = F.col("toxic") / bad, F.col("clean") / good
    spread = F.sqrt(total / (bad + good) * (1 - total / (bad + good)) * F.lit(1 / bad + 1 / good))
    chosen = (
        rows.mapInArrow(count, "feature bigint, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("_z", F.abs(p - q) / F.greatest(spread, F.lit(1e-12)))
        .filter((total >= params.min_docs) & (F.col("_z") >= params.min_z))
        .orderBy(F.desc("_z"), "feature")
        .limit(params.features)
    )
    picked = np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64)
    hasher = Hasher(params.bits)
    groups = [[t.encode() for t in group] for group in identity_terms]
    terms = sorted({t for group in groups for t in group})
    features = np.unique(np.concatenate([picked, *[np.array(hasher.word(t)) for t in terms]]))
    spark_terms = {t: i for i, t in enumerate(terms)}

    def rows_of(batches):
        own = Hasher(params.bits)
        for batch in batches:
            for part in slices(batch):
                lists, named = [], []
                for text, found in zip(blobs(part), own.texts(blobs(part))):
                    lists.append(np.flatnonzero(np.isin(features, found)).tolist())
                    words = {w.strip(_MARKS) for w in text.split()}
                    named.append([i for t, i in spark_terms.items() if t in words])
                yield pa.record_batch(
                    [
                        pa.array(lists, pa.list_(pa.int32())),
                        pa.array(named, pa.list_(pa.int32())),
                        part.column("toxic").cast(pa.int32()),
                    ],
                    names=["at", "named", "toxic"],
                )

    data = rows.mapInArrow(rows_of, "at array<int>, named array<int>, toxic int").toArrow()
    at = data["at"].combine_chunks()
    owner = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
    index = at.flatten().to_numpy(zero_copy_only=False)
    y = (data["toxic"].to_numpy() == 1).astype(float)
    swaps = _swaps(data["named"].to_pylist(), groups, spark_terms, hasher, features)
    weights, bias = _descend(owner, index, y, len(features), swaps, bias, params)
    dense = np.zeros(size, np.float32)
    dense[features] = weights
    return ToxicityModel(params.bits, dense, bias)


def _swaps(named, groups, numbers, hasher, features) -> np.ndarray:
    """Summed outer products of the feature changes of all counterfactual swaps, as (change, times)."""
    times: dict[tuple[bytes, bytes], int] = {}
    for present in named:
        for group in groups:
            inside = [t for t in group if numbers[t] in present]
            for a in inside:
                for b in group:
                    if b not in inside:
                        times[a, b] = times.get((a, b), 0) + 1
    changes = []
    for (a, b), n in sorted(times.items()):
        change = np.zeros(len(features))
        change[np.searchsorted(features, sorted(set(hasher.word(b))))] += 1
        change[np.searchsorted(features, sorted(set(hasher.word(a))))] -= 1
        changes.append(change * np.sqrt(n))
    return np.array(changes).reshape(-1, len(features))


def _descend(owner, index, y, size, swaps, bias, params):
    """Full-batch Adam on the penalised log loss."""
    n = len(y)
    theta = np.zeros(size + 1)
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, params.steps + 1):
        z = np.bincount(owner, theta[index], n) + theta[-1]
        error = (1 / (1 + np.exp(-z)) - y) / n
        g = np.empty_like(theta)
        g[:-1] = np.bincount(index, error[owner], size) + 2 * params.l2 * theta[:-1]
        if len(swaps):
            g[:-1] += 2 * params.fairness / n * (swaps.T @ (swaps @ theta[:-1]))
        g[-1] = error.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        rate = 0.1 * min(1.0, 2 * (1 - step / (params.steps + 1)))
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1].astype(np.float32), float(theta[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, cut: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text.

    ``score`` lies in 0 to 1, higher where label 1 is likelier; a null or empty
    text gets the model's constant. Only the text is read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights, model.bias))

    def score(batches):
        bits, weights, bias = shared.value
        hasher = Hasher(bits)
        for batch in batches:
            for part in slices(batch):
                z = np.array([weights[f].sum(dtype=float) for f in hasher.texts(blobs(part))])
                p = np.round(1 / (1 + np.exp(-np.clip(z + bias, -500, 500))), 9)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return _lowered(docs).mapInArrow(score, "doc_id bigint, score double, predicted int")
