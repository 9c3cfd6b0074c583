"""Parameter sweeps and comparisons of runs.

A run is a row ``name, method, scale, build_sec, recall_at_10, qps, edges``
(``scale`` names the data set and size the run was made on).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearfield.functions.vectors import qps
from nearfield.operators.candidates import bidirect, score_shortlist
from nearfield.operators.carve import build_partition
from nearfield.operators.evaluate import recall_at_k
from nearfield.operators.knn import ground_truth, top_per
from nearfield.operators.prune import hash_edges, keep_buckets, plane_set
from nearfield.operators.search import search_graphs
from nearfield.params import CarveParams, CarveRoots, PruneParams, SearchParams
from nearfield.runtime import materialize

METRIC_NAMES = ("build_sec", "recall_at_10", "qps", "edges")


@dataclass(frozen=True)
class SweepConfig:
    """One configuration of a sweep. What is None is that of the sweep."""

    name: str
    leaf_k: int = 12
    max_degree: int = 32
    beam: int = 128
    mode: str = "refined"
    carve: CarveParams | None = None
    replicas: int | None = None
    hash_bits: int | None = None

    def __post_init__(self):
        if self.mode not in ("hash", "refined"):
            raise ValueError(f"a sweep has modes hash and refined, got {self.mode!r}")


def _grid(name, cmax, replicas, leader_frac, max_leaders, leaf_k, max_degree, hash_bits, beam) -> SweepConfig:
    carve = CarveParams(cmax=cmax, leader_frac=leader_frac, max_leaders=max_leaders, fanout=1)
    return SweepConfig(name, leaf_k, max_degree, beam, "hash", carve, replicas, hash_bits)


#: The grid that hash-pruned graphs are tuned on, from fast to exact.
TUNING_GRID = [
    _grid("fast_a", 64, 1, 0.002, 32, 8, 24, 8, 96),
    _grid("fast_b", 96, 1, 0.003, 48, 12, 32, 10, 128),
    _grid("bal_a", 128, 1, 0.003, 64, 16, 40, 10, 128),
    _grid("bal_b", 128, 2, 0.008, 96, 20, 48, 12, 160),
    _grid("quality_a", 128, 2, 0.02, 1000, 12, 32, 12, 128),
    _grid("quality_b", 256, 3, 0.004, 128, 32, 64, 10, 256),
]


@dataclass
class SweepGraphs:
    """All graphs of a sweep: ``graph_id, src, dst, d, rank``, and what they took.

    ``work`` has ``graph_id, pairs``: scored pairs and pruned candidates of each.
    """

    edges: DataFrame
    work: DataFrame


def sweep_graphs(
    points: DataFrame,
    configs: list[SweepConfig],
    carve: CarveParams = CarveParams(),
    replicas: int = 1,
    prune: PruneParams = PruneParams(),
) -> DataFrame:
    """The graphs of all configurations: ``graph_id, src, dst, d, rank``."""
    return build_sweep(points, configs, carve, replicas, prune).edges


def build_sweep(
    points: DataFrame,
    configs: list[SweepConfig],
    carve: CarveParams = CarveParams(),
    replicas: int = 1,
    prune: PruneParams = PruneParams(),
) -> SweepGraphs:
    """Build the graphs of all configurations by one set of jobs, the configuration part of the key.

    Every different partition setting and replica is a root of one forest and
    is carved once. Where configurations share a root and the length of the
    shortlist, its leaves are scored once at the largest ``leaf_k``: smaller
    ones are prefixes of it by rank. Edges of the hash mode are hashed at the
    widest bit count, of which the lower bits serve the narrower ones.
    """
    spark = points.sparkSession
    settings = [(c.carve or carve, max(1, replicas if c.replicas is None else c.replicas)) for c in configs]
    roots = list(dict.fromkeys((s, r) for s, count in settings for r in range(count)))
    partition = build_partition(points, CarveRoots(tuple(roots)))

    # A variant is a root scored for one shortlist length; roots with several have their leaf ids repeated.
    caps = [max(1, 8 * c.max_degree) for c in configs]
    uses = [
        (g, roots.index((setting, r)), cap)
        for g, ((setting, count), cap) in enumerate(zip(settings, caps)) for r in range(count)
    ]
    variants = list(dict.fromkeys((root, cap) for _, root, cap in uses))
    named = spark.createDataFrame(
        [(v, root) for v, (root, _) in enumerate(variants)], "variant int, replica int"
    )
    leaves = partition.leaves.join(F.broadcast(named), "replica").select(
        F.col("variant").alias("replica"), "leaf_id", "vec_id"
    )
    deepest = max(c.leaf_k for c in configs)
    scored = materialize(
        score_shortlist(points, leaves, deepest, [cap for _, cap in variants], roots[0][0].metric), "scored"
    )
    per_graph = spark.createDataFrame(
        [(g, variants.index((root, cap)), configs[g].leaf_k) for g, root, cap in uses],
        "graph_id int, replica int, leaf_k int",
    )
    chosen = scored.join(F.broadcast(per_graph), "replica").filter(F.col("rank") <= F.col("leaf_k"))
    both = bidirect(chosen.select("graph_id", "src", "dst", "d"))
    edges = materialize(both.groupBy("graph_id", "src", "dst").agg(F.min("d").alias("d")), "sweep-candidates")

    modes = spark.createDataFrame(
        [
            (g, c.mode, c.max_degree, (1 << (prune.hash_bits if c.hash_bits is None else c.hash_bits)) - 1)
            for g, c in enumerate(configs)
        ],
        "graph_id int, mode string, max_degree int, mask bigint",
    )
    edges = edges.join(F.broadcast(modes), "graph_id").filter("max_degree > 0")
    key, most = ["graph_id", "src"], max(c.max_degree for c in configs)
    kept = ["graph_id", "src", "dst", "d", "rank"]
    degrees = F.broadcast(modes.select("graph_id", "max_degree"))
    hashed_configs = [c for c in configs if c.mode == "hash"]
    graphs = top_per(edges.filter("mode = 'refined'"), key, ["d", "dst"], max(0, most))
    graphs = graphs.filter("rank <= max_degree").select(*kept)
    if hashed_configs:
        bits = max(prune.hash_bits if c.hash_bits is None else c.hash_bits for c in hashed_configs)
        planes = plane_set(points, replace(prune, hash_bits=bits))
        hashed = hash_edges(edges.filter("mode = 'hash'"), points, prune, planes)
        hashed = hashed.withColumn("hash", F.col("hash").bitwiseAND(F.col("mask")))
        pruned = keep_buckets(hashed, key, most).join(degrees, "graph_id").filter("rank <= max_degree")
        graphs = graphs.unionByName(pruned.select(*kept))
    work = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("pairs"))
    return SweepGraphs(graphs, work)


def parameter_sweep(
    points: DataFrame,
    queries: DataFrame,
    configs: list[SweepConfig],
    carve: CarveParams = CarveParams(),
    replicas: int = 1,
    prune: PruneParams = PruneParams(),
    search: SearchParams = SearchParams(),
    truth: DataFrame | None = None,
    scale: str = "all",
) -> DataFrame:
    """One run per configuration: ``name, method, mode, scale, build_sec, recall_at_10, qps, edges``.

    All graphs are built and searched by the same jobs, with the graph as part
    of the key. Their wall clock is dealt out by work: building by the
    candidate edges of a graph, searching by the expansions its beam allows.
    The rows can be written as a summary, ranked, gated and compared.
    """
    spark = points.sparkSession
    start = time.monotonic()
    built = build_sweep(points, configs, carve, replicas, prune)
    graphs = materialize(built.edges, "sweep")
    build_sec = time.monotonic() - start
    beams = float(sum(max(0, c.beam) for c in configs)) or 1.0
    table = spark.createDataFrame(
        [(i, c.name, c.mode, c.beam, max(0, c.beam) / beams) for i, c in enumerate(configs)],
        "graph_id int, name string, mode string, beam int, share double",
    )
    asked = queries.join(F.broadcast(table.select("graph_id", "beam")), F.lit(True))
    start = time.monotonic()
    found = materialize(search_graphs(graphs, points, asked, search), "sweep-found")
    search_sec = time.monotonic() - start
    if truth is None:
        truth = ground_truth(points, queries, search.topk, search.metric)
    per_graph = truth.join(F.broadcast(table.select("graph_id")), F.lit(True))
    recall = recall_at_k(per_graph, found, search.topk, by=("graph_id",))
    edges = graphs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    count = queries.agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.coalesce("pairs", F.lit(0))
    # One row per configuration from here on.
    total = built.work.agg(F.greatest(F.sum("pairs"), F.lit(1)).alias("_pairs"))
    return (
        table.join(recall, "graph_id")
        .join(edges, "graph_id", "left")
        .join(built.work, "graph_id", "left")
        .join(F.broadcast(count), F.lit(True))
        .join(F.broadcast(total), F.lit(True))
        .select(
            "name", F.col("mode").alias("method"), "mode", F.lit(scale).alias("scale"),
            (F.lit(build_sec) * pairs / F.col("_pairs")).alias("build_sec"),
            F.col("recall").alias("recall_at_10"),
            qps("_n", F.lit(search_sec) * F.col("share")).alias("qps"),
            F.coalesce("edges", F.lit(0)).alias("edges"),
        )
    )


def rank_runs(runs: DataFrame) -> DataFrame:
    """Position of every run in its scale: recall down, speed down, build time up."""
    order = W.partitionBy("scale").orderBy(
        F.desc("recall_at_10"), F.desc("qps"), F.asc("build_sec"), F.asc("name")
    )
    return runs.withColumn("position", F.row_number().over(order))


def recall_gate(runs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Runs with ``passed``, and ``first_passing``, the fastest-built passing run of the scale."""
    passing = F.col("recall_at_10") >= threshold
    best = runs.filter(passing).groupBy("scale").agg(
        F.min(F.struct("build_sec", "name")).alias("_best")
    )
    return (
        runs.withColumn("passed", passing)
        .join(best, "scale", "left")
        .withColumn("first_passing", F.col("_best.name"))
        .drop("_best")
    )


def recall_matched(runs: DataFrame, method: str, other: str) -> DataFrame:
    """For each run of ``method``, the run of ``other`` at the same scale with the nearest recall.

    Ties go to the shorter build, then the name. Runs of the two methods are
    sorted together by recall, and the nearest is the last one at or below or
    the first one at or above: no run meets more than two partners.
    """
    fields = F.struct("build_sec", "name", "recall_at_10", "qps")
    kind = runs.select(fields.alias("r")).schema["r"].dataType
    nothing = F.lit(None).cast(kind)
    partners = (
        runs.filter(F.col("method") == other)
        .groupBy("scale", "recall_at_10")
        .agg(F.min(fields).alias("_run"))
        .select("scale", F.col("recall_at_10").alias("_at"), "_run", nothing.alias("_own"))
    )
    own = runs.filter(F.col("method") == method).select(
        "scale",
        F.col("recall_at_10").alias("_at"),
        nothing.alias("_run"),
        fields.alias("_own"),
    )
    both = partners.unionByName(own)
    order = W.partitionBy("scale").orderBy("_at")
    below = F.last("_run", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, 0))
    above = F.first("_run", ignorenulls=True).over(order.rangeBetween(0, W.unboundedFollowing))

    def gap(run) -> Column:
        return F.abs(run["recall_at_10"] - F.col("_own.recall_at_10"))

    def choice(name) -> Column:
        run = F.col(name)
        return F.when(
            run.isNotNull(),
            F.struct(F.round(gap(run), 12).alias("gap"), run["build_sec"].alias("build_sec"),
                     run["name"].alias("name"), run["qps"].alias("qps"),
                     run["recall_at_10"].alias("recall")),
        )

    return (
        both.withColumn("_below", below)
        .withColumn("_above", above)
        .filter(F.col("_own").isNotNull())
        .withColumn("_pick", F.least(choice("_below"), choice("_above")))
        .filter(F.col("_pick").isNotNull())
        .select(
            "scale",
            F.col("_own.name").alias("name"),
            F.col("_pick.name").alias("partner"),
            F.col("_own.recall_at_10").alias("recall_at_10"),
            F.col("_pick.recall").alias("partner_recall"),
            (F.col("_own.build_sec") / F.col("_pick.build_sec")).alias("build_ratio"),
            (F.col("_pick.qps") / F.col("_own.qps")).alias("qps_ratio"),
        )
    )


def config_delta(runs: DataFrame, baseline: str) -> DataFrame:
    """Absolute and percent change of every metric against the run named ``baseline``."""
    base = runs.filter(F.col("name") == baseline).select(
        "scale", *[F.col(m).cast("double").alias(f"_{m}") for m in METRIC_NAMES]
    )
    compared = runs.filter(F.col("name") != baseline).join(base, "scale")
    deltas = []
    for metric in METRIC_NAMES:
        change = F.col(metric).cast("double") - F.col(f"_{metric}")
        percent = F.when(F.col(f"_{metric}") != 0, 100.0 * change / F.col(f"_{metric}"))
        deltas += [change.alias(f"{metric}_delta"), percent.alias(f"{metric}_pct")]
    return compared.select("scale", "name", *deltas)


def reconcile_runs(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Differences between recorded and measured metrics, one row per finding.

    Both sides have ``name, mode`` and the metrics. ``status`` is
    ``missing_result``, ``missing_manifest``, ``missing_field`` or ``mismatch``
    (beyond 1e-9, relative or absolute). Agreement gives no row.
    """
    from functools import reduce

    def long(df: DataFrame, name: str) -> DataFrame:
        numeric = [f"'{m}', cast(`{m}` as double), cast(null as string)" for m in METRIC_NAMES]
        parts = ["'mode', cast(null as double), mode", *numeric]
        stack = f"stack({len(parts)}, {', '.join(parts)}) as (metric, {name}, {name}_text)"
        return df.select("name", F.expr(stack)).withColumn(f"_{name}", F.lit(True))

    both = long(manifest, "recorded").join(long(results, "measured"), ["name", "metric"], "full_outer")
    recorded, measured = F.col("recorded"), F.col("measured")
    absent = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(F.col(s).cast("string"), F.col(f"{s}_text")).isNull()
            for s in ("recorded", "measured")
        ],
    )
    tolerance = F.greatest(F.lit(1e-9) * F.greatest(F.abs(recorded), F.abs(measured)), F.lit(1e-9))
    differs = (F.abs(recorded - measured) > tolerance) | (
        F.col("recorded_text") != F.col("measured_text")
    )
    status = (
        F.when(F.col("_measured").isNull(), "missing_result")
        .when(F.col("_recorded").isNull(), "missing_manifest")
        .when(absent, "missing_field")
        .when(F.coalesce(differs, F.lit(False)), "mismatch")
    )
    return (
        both.withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select("name", "metric", "status", "recorded", "measured")
    )
