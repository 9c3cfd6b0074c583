"""Recall of result lists ``query_id, rank, vec_id`` against truth lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.runtime import sorted_join


def recall_at_k(truth: DataFrame, found: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over truth queries of |found[:k] & truth[:k]| / k, one row (per ``by``).

    The denominator is always ``k``; a query without results counts as zero;
    empty truth gives zero.
    """
    keys = [*by, "query_id"]
    hits = found.filter(F.col("rank") <= k).select(*keys, "vec_id").distinct()
    hits = hits.withColumn("hit", F.lit(1))
    per_query = (
        sorted_join(truth.withColumn("hit_rank", F.col("rank") <= k), hits, [*keys, "vec_id"], "left")
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("hit_rank"), F.coalesce("hit", F.lit(0))).otherwise(0)).alias("hits"))
    )
    mean = F.coalesce(F.avg(F.col("hits") / F.lit(float(k))), F.lit(0.0)).alias("recall")
    return per_query.groupBy(*by).agg(mean) if by else per_query.agg(mean)


def recall_micro(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Hits of the found top-k anywhere in the truth row, over the sum of min(k, |truth|).

    Only queries that have results count, which is looser than ``recall_at_k``
    when truth rows are longer than ``k``.
    """
    top = found.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("vec_id").alias("top"))
    # Truth may be all pairs' work: it is read once.
    rows = truth.groupBy("query_id").agg(F.collect_list("vec_id").alias("row"), F.least(F.lit(k), F.count(F.lit(1))).alias("n"))
    hits = F.size(F.filter("top", lambda x: F.array_contains("row", x)))
    sums = sorted_join(rows, top, "query_id").agg(F.sum(hits).alias("hits"), F.sum("n").alias("possible"))
    return sums.select(
        F.when(F.coalesce("possible", F.lit(0)) == 0, F.lit(0.0))
        .otherwise(F.col("hits") / F.col("possible"))
        .alias("recall")
    )
