"""Graph building, evaluation and the build profile, end to end."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from nearfield.functions.vectors import qps
from nearfield.operators.candidates import (
    Candidates, build_candidates, candidate_stats, score_partition,
)
from nearfield.operators.carve import build_partition
from nearfield.operators.cells import build_cell_index, probe_cells
from nearfield.operators.evaluate import recall_at_k, recall_micro
from nearfield.operators.graph import edge_count
from nearfield.operators.knn import exact_knn_graph, ground_truth
from nearfield.operators.prune import (
    count_scans, hash_edges, hash_prune, keep_buckets, prune_totals, refine_degree,
)
from nearfield.operators.search import beam_search
from nearfield.params import BuildParams, SearchParams
from nearfield.runtime import materialize

MODES = ("hash", "refined", "exact")
#: The mode of ``run_benchmark`` without a graph.
BASELINE = "cells"


def build_graph_hashprune(points: DataFrame, params: BuildParams) -> DataFrame:
    """Candidates pruned to one neighbour per residual-hash bucket; squared L2 only."""
    if params.carve.metric != "l2":
        raise ValueError("the hash-pruned graph supports only the l2 metric")
    candidates = build_candidates(points, params.candidates())
    return hash_prune(candidates.edges, points, params.prune)


def build_graph_refined(points: DataFrame, params: BuildParams) -> DataFrame:
    """Candidates reduced to the nearest ``max_degree``; both metrics."""
    candidates = build_candidates(points, params.candidates())
    return refine_degree(
        candidates.edges, points, params.prune.max_degree, params.carve.metric
    )


def build_graph_exact(points: DataFrame, params: BuildParams) -> DataFrame:
    """Brute-force candidates reduced to the nearest ``max_degree``."""
    degree, metric = params.prune.max_degree, params.carve.metric
    return refine_degree(exact_knn_graph(points, degree, metric), points, degree, metric)


def build_graph(points: DataFrame, mode: str, params: BuildParams) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    build = {
        "hash": build_graph_hashprune,
        "refined": build_graph_refined,
        "exact": build_graph_exact,
    }[mode]
    return build(points, params)


def evaluate_graph(
    edges: DataFrame,
    points: DataFrame,
    queries: DataFrame,
    search: SearchParams,
    truth: DataFrame | None = None,
    recall_k: int | None = None,
) -> DataFrame:
    """Recall of the beam search on a graph and its edge count, one row.

    Without ``truth`` it is computed on the given points.
    """
    k = search.topk if recall_k is None else recall_k
    if truth is None:
        truth = ground_truth(points, queries, k, search.metric)
    found = beam_search(edges, points, queries, search)
    recall = recall_at_k(truth, found, k).select(F.col("recall").alias("recall_at_10"))
    return recall.join(F.broadcast(edge_count(edges)), F.lit(True))


def run_benchmark(
    points: DataFrame,
    queries: DataFrame,
    mode: str,
    params: BuildParams,
    search: SearchParams,
    truth: DataFrame | None = None,
) -> DataFrame:
    """Build, search and score: ``mode, build_sec, recall_at_10, qps, edges``.

    The seconds are wall clock around the jobs that materialize the graph and
    the results. The hash mode scores recall at 10, the others at ``topk``.
    Mode ``cells`` is the approximate index to compare with: its recall is that
    of ``recall_micro``, over whole truth rows, and its edges are the points that the cells hold.
    """
    k = 10 if mode == "hash" else search.topk
    start = time.monotonic()
    if mode == BASELINE:
        index = build_cell_index(points, queries, k, metric=search.metric)
        edges = index.about.select(F.col("points").alias("edges"))
    else:
        graph = materialize(build_graph(points, mode, params), "graph")
        edges = edge_count(graph)
    build_sec = time.monotonic() - start
    start = time.monotonic()
    if mode == BASELINE:
        found = materialize(probe_cells(index, queries, k), "found")
    else:
        found = materialize(beam_search(graph, points, queries, search), "found")
    query_sec = time.monotonic() - start
    if truth is None:
        truth = ground_truth(points, queries, k, search.metric)
    count = queries.agg(F.count(F.lit(1)).alias("_n"))
    recall = recall_micro(truth, found, k) if mode == BASELINE else recall_at_k(truth, found, k)
    return (
        recall.join(F.broadcast(edges), F.lit(True))
        .join(F.broadcast(count), F.lit(True))
        .select(
            F.lit(mode).alias("mode"),
            F.lit(build_sec).alias("build_sec"),
            F.col("recall").alias("recall_at_10"),
            qps("_n", F.lit(query_sec)).alias("qps"),
            "edges",
        )
    )


@dataclass
class BuildProfile:
    """Counters of a hash-pruned build and the seconds of its stages."""

    counters: DataFrame
    seconds: dict[str, float]
    edges: DataFrame

    def row(self) -> DataFrame:
        timed = [F.lit(value).alias(name) for name, value in self.seconds.items()]
        return self.counters.select(*timed, "*")


def build_profile(points: DataFrame, params: BuildParams) -> BuildProfile:
    """Build the hash-pruned graph stage by stage and report its counters.

    ``partition_sec``, ``leaf_knn_sec`` and ``prune_sec`` are wall clock around the
    jobs that write the leaves, the scored and united candidates, and the graph.
    Candidates and edges are counted while they are written; buckets are hashed
    once, for the graph and for the counters of the scan, which is not timed.
    """
    wanted = params.candidates()
    start = time.monotonic()
    partition = build_partition(points, wanted.carve, wanted.replica_count)
    carved = time.monotonic()
    scored, linked = Observation(), Observation()
    candidates: Candidates = score_partition(points, partition, wanted, scored)
    candidates.edges = materialize(candidates.edges, "candidates")
    built = time.monotonic()
    hashed = materialize(hash_edges(candidates.edges, points, params.prune), "hashed")
    edges = keep_buckets(hashed.filter("src <> dst"), ["src"], params.prune.max_degree)
    edges = materialize(edges.observe(linked, F.count(F.lit(1)).alias("edges")), "graph")
    pruned = time.monotonic()
    totals = prune_totals(count_scans(hashed, params.prune.max_degree)).withColumn(
        "prune_final_edges", F.lit(linked.get["edges"]).cast("bigint")
    )
    counters = candidate_stats(candidates, scored.get["scored"]).join(F.broadcast(totals), F.lit(True))
    seconds = {"partition_sec": carved - start, "leaf_knn_sec": built - carved, "prune_sec": pruned - built}
    return BuildProfile(counters, seconds, edges)
