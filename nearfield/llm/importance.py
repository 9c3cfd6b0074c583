"""Importance resampling of documents towards the labelled good ones.

General over ``doc_id, text`` and labels ``doc_id, quality``: the library's own
records hold no texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import (
    WordTable, bernoulli, blobs, drop_clashing, offsets_of, segment_sums, slices, text_rows,
)
from nearfield.runtime import materialize, positions

#: Words and runs of other marks; case is kept.
_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")


@dataclass(frozen=True)
class ResampleParams:
    """``buckets`` n-gram features; at most ``label_limit`` labelled rows name the target.

    ``prior`` is the number of raw features per bucket that the target model
    starts from, so that rare features weigh little until they are seen.
    """

    buckets: int = 1 << 14
    prior: float = 16.0
    label_limit: int = 20_000
    seed: int = 17


def _learn(words):
    return (np.array([zlib.crc32(w) for w in words], np.uint64),)


def _features(table: WordTable, texts: list[bytes], buckets: int):
    """Hashed unigrams and bigrams of every text: flat features and offsets.

    A word that follows itself counts as one feature whatever the word is.
    """
    out = []
    for tokens in table.prepare([_TOKEN.findall(text) for text in texts]):
        numbers = table.numbers(tokens)
        if not len(numbers):
            out.append(np.zeros(0, np.int64))
            continue
        one = table.columns[0][numbers]
        with np.errstate(over="ignore"):
            two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            two[one[:-1] == one[1:]] = 1
            both = np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), two])
            both ^= both >> np.uint64(29)
            both *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(((both >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), offsets_of(list(map(len, out)))


def target_sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids in hash order, each once: ``doc_id, _good``."""
    once = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
    good = once.agg((F.max("quality") == 1).alias("_good"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(docs: DataFrame, labels: DataFrame, params: ResampleParams = ResampleParams()):
    """(log ratio of every feature, share of good labels).

    The raw model counts the features of all documents; the target model those
    of the documents that a bounded sample of labels calls good. Counts are
    summed inside tasks and again by Spark; the driver gets one row per bucket.
    """
    size = params.buckets
    # At most label_limit rows of two columns.
    sample = F.broadcast(target_sample(labels, params.label_limit))
    rows = text_rows(docs).join(sample, "doc_id", "left")
    rows = rows.select("_text", F.coalesce("_good", F.lit(False)).alias("_good"))

    def count(batches):
        raw, target, table = np.zeros(size, np.int64), np.zeros(size, np.int64), WordTable(_learn)
        for batch in batches:
            for part in slices(batch):
                features, offsets = _features(table, blobs(part), size)
                raw += np.bincount(features, minlength=size)
                good = np.repeat(np.array(part.column("_good").to_pylist(), bool), np.diff(offsets))
                target += np.bincount(features[good], minlength=size)
        seen = np.flatnonzero(raw)
        yield pa.record_batch(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])],
            names=["bucket", "raw", "target"],
        )

    counted = rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for bucket, n, m in sums.collect():
        raw[bucket], target[bucket] = n, m
    if not target.sum():
        return np.zeros(size), 1.0
    share, prior = (raw + 1) / (raw.sum() + size), params.prior * size
    ratio = np.log((target + prior * share) / (target.sum() + prior)) - np.log(share)
    stats = target_sample(labels, params.label_limit).agg(F.avg(F.col("_good").cast("double")))
    return ratio, float(stats.first()[0])


def log_weights(docs: DataFrame, ratio: np.ndarray, params: ResampleParams) -> DataFrame:
    """``docs`` with the log importance weight of every whole text (``log_weight``; empty: 0)."""
    docs = drop_clashing(docs, "log_weight", "_text")
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")).cast("binary"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    names = docs.columns

    def score(batches):
        table = WordTable(_learn)
        for batch in batches:
            for part in slices(batch):
                features, offsets = _features(table, blobs(part), len(shared.value))
                # Rounded, so that the verdict does not depend on the order of the sum.
                weight = np.round(segment_sums(shared.value[features], offsets), 6)
                yield pa.record_batch(
                    [part.column(n) for n in names] + [pa.array(weight)],
                    names=[*names, "log_weight"],
                )

    return rows.mapInArrow(score, ", ".join([*fields, "log_weight double"]))


def resample(
    docs: DataFrame, labels: DataFrame, params: ResampleParams = ResampleParams()
) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_key`` and ``kept``.

    ``sample_key`` is the log weight plus Gumbel noise from the hash of the
    seed and ``doc_id``; the k rows with the largest keys are kept, which draws
    k rows without replacement by their weights. k is the expected number of
    documents of the target: the sum of the posteriors that the two models and
    the share of good labels give. Rows with the key of the last kept one are
    kept too, so repeated rows share a verdict. Without good labels all weights
    are 0 and all rows are kept; so is an empty table.
    """
    docs = drop_clashing(docs, "sample_key", "kept")
    ratio, share = fit_ratio(docs, labels, params)
    uniform = bernoulli(params.seed, "doc_id") + F.lit(0.5 / 4294967296.0)
    gumbel = -F.log(-F.log(uniform))
    scored = log_weights(docs, ratio, params).withColumn(
        "sample_key", F.round(F.col("log_weight") + gumbel, 6)
    )
    keys = materialize(scored.select("doc_id", "log_weight", "sample_key"), "sample-keys")
    odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("log_weight") + F.lit(float(odds)))))
    k = keys.agg(F.sum(posterior)).first()[0]
    k = int(round(k or 0))
    order = keys.select((-F.col("sample_key")).alias("_order"), "doc_id")
    last = positions(order, [], ["_order", "doc_id"], "_rank").filter(F.col("_rank") == k).first()
    bound = float("inf") if last is None else -last["_order"]
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(bound))
