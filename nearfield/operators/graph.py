"""Neighbour graphs as edge tables ``src, dst, d, rank``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.runtime import sorted_join


def adjacency(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Ordered neighbour lists ``src, nbrs``; points without edges have an empty list.

    Meant for pruned graphs, where a list has at most ``max_degree`` entries.
    """
    lists = edges.groupBy("src").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]
        ).alias("nbrs")
    )
    nodes = points.select(F.col("vec_id").alias("src"))
    return sorted_join(nodes, lists, "src", "left").select(
        "src", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs")
    )


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"))


def num_nodes(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("nodes"))
