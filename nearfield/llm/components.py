"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.runtime import SLICE_ROWS, hot_key_join, materialize, setting

#: Rows that are worth a task of their own.
TASK_ROWS = 50_000


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` to as many tasks as ``rows`` are worth; large tables are left to Spark."""
    if rows > setting(df.sparkSession, SLICE_ROWS):
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs``, about ``rows`` of them, with the least ``v`` of each ``u``.

    Hubs are summed first and joined in slices. Where no more rows than a slice
    has are left, as in late rounds, there is no hub to look for.
    """
    if rows <= setting(pairs.sparkSession, SLICE_ROWS):
        pairs = _spread(pairs, rows, "u")
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return hot_key_join(pairs, least, ["u"], "v")


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its least node.

    Each round hangs the larger neighbours of every node, then the smaller
    ones, under its least neighbour, until nothing changes; the number of
    rounds grows with the logarithm of the graph. Rounds are written to the
    shared folder. Null ends and self links are ignored; repeated links and
    both directions do no harm; without links the result is empty.
    """
    hi, lo = F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    edges = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    edges = materialize(edges.select(hi, lo).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rows = 2 * state[0]
        large = _with_least(both, rows).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        )
        large = materialize(_spread(large, rows, "u", "v").distinct(), "large-star")
        stars = _with_least(large, rows)
        small = stars.select("u", F.col("m").alias("v")).unionByName(
            stars.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialize(_spread(small, rows, "u", "v").distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
