"""Nearest neighbours inside each leaf; a point in two leaves is answered in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nearfield.operators.candidates import bidirect, leaf_key
from nearfield.operators.knn import topk_join
from nearfield.runtime import positions, sorted_join

EDGE = ["replica", "leaf_id", "src", "dst", "d"]


def leaf_knn_exact(
    points: DataFrame,
    leaves: DataFrame,
    k: int,
    bidirected: bool = False,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Exact top-k of every leaf member among the other members, squared L2.

    Result ``replica, leaf_id, src, dst, d``; with ``bidirected`` also the
    reverse of every edge, repeats included.
    """
    members = sorted_join(leaves, points, "vec_id").withColumn("leaf", leaf_key())
    found = topk_join(
        members.withColumnRenamed("vec_id", "query_id"),
        members,
        k,
        group="leaf",
        exclude_self=True,
        keep=("replica", "leaf_id"),
        broadcast_bytes=broadcast_bytes,
    )
    edges = found.withColumnsRenamed({"query_id": "src", "vec_id": "dst"}).select(*EDGE)
    return bidirect(edges) if bidirected else edges


def leaf_knn_blocked(
    points: DataFrame, leaves: DataFrame, k: int, bidirected: bool = False
) -> DataFrame:
    """``leaf_knn_exact`` with every leaf shuffled to blocks, whatever the table size."""
    return leaf_knn_exact(points, leaves, k, bidirected, broadcast_bytes=0)


def leaf_knn_capped(
    points: DataFrame, leaves: DataFrame, k: int, scan_cap: int, bidirected: bool = False
) -> DataFrame:
    """Like ``leaf_knn_exact``, but a point looks at ``scan_cap`` others only.

    The member at position p of a leaf of m starts at position
    ``(p * 2654435761 mod 2**32) mod m`` and takes the next ``scan_cap`` members
    other than itself, wrapping round. Leaves with at most ``scan_cap`` others
    are scanned whole.
    """
    if scan_cap <= 0:
        return leaf_knn_exact(points, leaves, k, bidirected)
    sizes = leaves.groupBy("replica", "leaf_id").agg(F.count(F.lit(1)).alias("m"))
    at = sorted_join(positions(leaves, ["replica", "leaf_id"], ["vec_id"]), sizes, ["replica", "leaf_id"])
    at = at.withColumn("pos", F.col("pos") - 1)
    start = F.expr("(pos * 2654435761L % 4294967296L) % m")
    # The own position costs one step more when it lies inside the scan.
    steps = F.expr(
        f"IF(m - 1 <= {scan_cap}, m, {scan_cap} + IF(pmod(pos - start, m) < {scan_cap}, 1, 0))"
    )
    scans = (
        at.withColumn("start", start)
        .withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)))
        .withColumn("pos", F.expr("(start + step) % m"))
        .select("replica", "leaf_id", F.col("vec_id").alias("src"), "pos")
    )
    targets = at.select("replica", "leaf_id", "pos", F.col("vec_id").alias("dst"))
    pairs = sorted_join(scans, targets, ["replica", "leaf_id", "pos"]).filter(F.col("src") != F.col("dst"))
    # A point's scan is a list of at most ``scan_cap`` ids, and is scored in its leaf: a vector
    # moves once per membership, not once per pair.
    lists = pairs.groupBy("replica", "leaf_id", "src").agg(F.collect_list("dst").alias("ids"))
    members = sorted_join(leaves, points, "vec_id").withColumn("leaf", leaf_key())
    scans = sorted_join(members, lists.withColumnRenamed("src", "vec_id"), ["replica", "leaf_id", "vec_id"])
    found = topk_join(
        scans.withColumnRenamed("vec_id", "query_id"), members, k, group="leaf", exclude_self=True,
        listed="ids", keep=("replica", "leaf_id"),
    )
    edges = found.withColumnsRenamed({"query_id": "src", "vec_id": "dst"}).select(*EDGE)
    return bidirect(edges) if bidirected else edges
