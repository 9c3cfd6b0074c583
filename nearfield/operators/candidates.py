"""Neighbour candidates: points that share a leaf, listed, capped and scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from nearfield.operators.carve import Partition, build_partition, partition_stats
from nearfield.operators.knn import top_per, topk_join
from nearfield.params import CandidateParams
from nearfield.runtime import hot_key_join, materialize, sorted_join


def leaf_key() -> Column:
    """One bigint per (replica, leaf)."""
    return F.shiftleft(F.col("replica").cast("bigint"), 40) + F.col("leaf_id")


def leaf_heads(leaves: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` members of every leaf by id, or all of them for 0."""
    if limit <= 0:
        return leaves
    return top_per(leaves, ["replica", "leaf_id"], ["vec_id"], limit).drop("rank")


def widest(cap: int | list[int]) -> int:
    """The largest of several caps; none (0) is the widest of all."""
    if isinstance(cap, int):
        return cap
    return 0 if min(cap, default=0) <= 0 else max(cap)


def shortlist(leaves: DataFrame, cap: int | list[int] = 0) -> DataFrame:
    """Co-members of every point as ``replica, vec_id, ids``, in listing order.

    The order is leaf number, then id; the point itself and repeats are left
    out; ``cap`` keeps the first so many. Under a cap only the first ``cap + 1``
    members of a leaf can be listed for anyone, so a leaf is represented by
    one bounded array, however many points it holds, and no pair of members
    is ever emitted as a row. A list of caps has one for every replica.

    Without a cap the list is quadratic in the leaf size by definition;
    ``score_shortlist`` with ``cap=0`` finds the best of all co-members without it.
    """
    most = widest(cap)
    heads = (
        leaf_heads(leaves, most + 1 if most > 0 else 0)
        .groupBy("replica", "leaf_id")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    per_leaf = hot_key_join(leaves, heads, ["replica", "leaf_id"], "vec_id")
    listed = per_leaf.groupBy("replica", "vec_id").agg(
        F.array_sort(F.collect_list(F.struct("leaf_id", "ids"))).alias("lists")
    )
    ids = F.array_remove(
        F.array_distinct(F.flatten(F.transform("lists", lambda x: x["ids"]))), F.col("vec_id")
    )
    if most > 0:
        own = F.lit(cap) if isinstance(cap, int) else F.get(F.array(*map(F.lit, cap)), F.col("replica"))
        ids = F.slice(ids, F.lit(1), own)
    return listed.select("replica", "vec_id", ids.alias("ids"))


def shortlist_rows(listed: DataFrame) -> DataFrame:
    """A shortlist as rows ``replica, src, rank, dst``."""
    return listed.select(
        "replica", F.col("vec_id").alias("src"), F.posexplode("ids").alias("_p", "dst")
    ).select("replica", "src", (F.col("_p") + 1).alias("rank"), "dst")


def score_shortlist(
    points: DataFrame, leaves: DataFrame, k: int, cap: int | list[int] = 0, metric: str = "l2"
) -> DataFrame:
    """The ``k`` best-scored shortlist entries of every point, per replica.

    ``cap`` may list one cap per replica, all of them positive.

    Result ``replica, src, dst, d, rank``. Scoring happens leaf by leaf: a
    leaf's members meet only the members that can be on a list, so vectors
    move once per membership and never once per pair.
    """
    key = leaf_key().alias("leaf")
    members = leaves.select("replica", "vec_id", key)
    most = widest(cap)
    if most > 0:
        targets = leaf_heads(leaves, most + 1).select("vec_id", key)
        members = sorted_join(members, shortlist(leaves, cap), ["replica", "vec_id"])
    else:
        targets = members.select("vec_id", "leaf")
    queries = sorted_join(members, points, "vec_id").withColumnRenamed("vec_id", "query_id")
    # Counted from ids and the dimension, without joining the vectors for it.
    sizes = leaves.groupBy("replica", "leaf_id").agg(F.count(F.lit(1)).alias("n"))
    met = F.least("n", F.lit(most + 1)) if most > 0 else F.col("n")
    rows = sizes.agg(F.sum(met)).first()[0] or 0
    dim = points.agg(F.max(F.size("v"))).first()[0] or 0
    found = topk_join(
        queries,
        sorted_join(targets, points, "vec_id"),
        k,
        metric,
        group="leaf",
        exclude_self=True,
        listed="ids" if most > 0 else None,
        keep=("replica",),
        base_bytes=rows * dim * 8,
        dim=dim,
    )
    # A pair met in two leaves has the same score twice and shares its dense rank.
    order = W.partitionBy("replica", "query_id").orderBy("d", "vec_id")
    return (
        found.withColumn("rank", F.dense_rank().over(order))
        .filter(F.col("rank") <= k)
        .select("replica", F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "d", "rank")
        .dropDuplicates(["replica", "src", "dst"])
    )


def bidirect(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; other columns are kept."""
    other = {"src": "dst", "dst": "src"}
    swapped = edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


def union_replicas(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` over all replicas; equal pairs have equal scores."""
    return edges.groupBy("src", "dst").agg(F.min("d").alias("d"))


@dataclass
class Candidates:
    """Distinct candidate edges ``src, dst, d`` and what they came from."""

    edges: DataFrame
    scored: DataFrame
    partition: Partition
    bidirected: bool


def build_candidates(points: DataFrame, params: CandidateParams) -> Candidates:
    """Partition all replicas, score their shortlists, reverse and unite the edges."""
    partition = build_partition(points, params.carve, params.replica_count)
    return score_partition(points, partition, params)


def score_partition(
    points: DataFrame, partition: Partition, params: CandidateParams, observed: Observation | None = None
) -> Candidates:
    """The candidates of a partition; ``observed`` gets ``scored``, the rows written, on the way."""
    metric = params.carve.metric
    scored = score_shortlist(points, partition.leaves, params.leaf_k, params.cap, metric)
    if observed is not None:
        scored = scored.observe(observed, F.count(F.lit(1)).alias("scored"))
    scored = materialize(scored, "scored")
    edges = scored.select("src", "dst", "d")
    edges = bidirect(edges) if params.bidirected else edges
    return Candidates(union_replicas(edges), scored, partition, params.bidirected)


def candidate_stats(candidates: Candidates, scored: int | None = None) -> DataFrame:
    """Partition counters over all replicas and the edge count before removing repeats.

    ``scored`` is the number of scored rows where that was counted already.
    """
    partition = partition_stats(candidates.partition).agg(
        F.sum("leaf_count").alias("num_leaves"),
        F.sum("assignment_total").alias("partition_assignment_total"),
        F.sum("points_with_overlap").alias("partition_points_with_overlap"),
        F.max("max_membership").alias("partition_max_membership"),
        F.min("min_leaf_size").alias("partition_min_leaf_size"),
        F.max("max_leaf_size").alias("partition_max_leaf_size"),
        F.sum("fallback_chunk_splits").alias("partition_fallback_chunk_splits"),
    )
    factor = 2 if candidates.bidirected else 1
    if scored is not None:
        return partition.withColumn("candidate_edges", F.lit(scored * factor).cast("bigint"))
    count = candidates.scored.agg((F.count(F.lit(1)) * factor).alias("candidate_edges"))
    return partition.join(F.broadcast(count), F.lit(True))
