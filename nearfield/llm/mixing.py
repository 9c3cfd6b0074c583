"""Mixing sources to target weights, with DataFrame functions alone.

General over ``doc_id, text, source``: the library's own records hold no texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import bernoulli, drop_clashing
from nearfield.runtime import hot_key_join, materialize, positions

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, one small row each, are sent to all tasks.
BROADCAST_SOURCES = 10_000
_KEY = "_mix_source"


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def _key():
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def source_targets(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3
) -> DataFrame:
    """Per source: ``_mix_source, source_size, target, n_sources``.

    Sources in code-point order, null last, take ``weights`` in turn. Targets
    share the words of all sources by weight; none is above ``most`` times its
    source's words, and what is cut off is shared again by weight among the
    others until none is above. A source without words has target 0.
    """
    sizes = docs.select("source", _size().alias("_size"))
    sums = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    ranked = positions(
        sums.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_rank"
    )
    turn = ((F.col("_rank") - 1) % len(weights)).cast("int")
    weight = F.get(F.array(*map(F.lit, weights)), turn)
    table = materialize(
        ranked.select(
            _key().alias(_KEY),
            "source_size",
            weight.cast("bigint").alias("_weight"),
            (F.col("source_size") * most).alias("_cap"),
        ),
        "sources",
    )
    share, capped = 0.0, -1
    while True:
        full = F.col("_cap") <= share * F.col("_weight")
        row = table.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, 1).otherwise(0)).alias("capped"),
            F.sum(F.when(full, F.col("_cap")).otherwise(0)).alias("used"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("free"),
        ).first()
        if not row["free"] or row["capped"] == capped:
            break
        capped, share = row["capped"], (row["total"] - row["used"]) / row["free"]
    target = F.least(F.col("_cap").cast("double"), F.lit(float(share)) * F.col("_weight"))
    return table.select(
        _KEY, "source_size", target.alias("target"), F.lit(row["n"]).alias("n_sources")
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17
) -> DataFrame:
    """Every document with ``size, source_size, target`` and its number of ``copies``.

    A source's repetition rate is target / source_size; a document gets
    floor(rate) copies plus one with probability equal to the fraction, drawn
    from the hash of the seed and its ``doc_id``. So reruns agree, rows that
    share a ``doc_id`` share the draw, and no document exceeds ``most`` copies.
    Null texts have size 0; an empty table gives an empty table. Columns of
    ``docs`` with the names of added ones are replaced.
    """
    docs = drop_clashing(docs, "size", "source_size", "target", "copies", _KEY)
    targets = source_targets(docs, weights, most)
    few = targets.first()
    rows = docs.withColumn("size", _size()).withColumn(_KEY, _key())
    if few is None or few["n_sources"] <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(targets.drop("n_sources")), _KEY)
    else:
        joined = hot_key_join(rows, targets.drop("n_sources"), [_KEY], "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = bernoulli(seed, "doc_id") < rate - F.floor(rate)
    copies = F.floor(rate) + F.when(extra, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop(_KEY)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17):
    """The mixed documents: each row of ``docs`` repeated as often as planned, copies numbered in ``copy``."""
    planned = plan_mix(drop_clashing(docs, "copy"), weights, most, seed).filter("copies > 0")
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(
        "size", "source_size", "target", "copies"
    )
