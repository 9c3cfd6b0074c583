"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import settings as P
from nearfield.functions import vectors as V
from nearfield.operators import candidates as C
from nearfield.operators import carve as R
from nearfield.operators import evaluate as E
from nearfield.operators import graph as G
from nearfield.operators import knn as N
from nearfield.operators import leafknn as L
from nearfield.operators import prune as H
from nearfield.operators import search as S
from nearfield.operators.cells import approx_baseline, build_cell_index, open_cell_index, probe_cells
from nearfield.plans import build as B
from nearfield.plans import experiments as X
from nearfield.runtime import materialize, ship_package, table_path
from nearfield.sources import results as IO
from nearfield.sources import tables as T
from nearfield.sources import vecfile as VF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STAGES: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def stage(build):
    """Keep an intermediate table that several queries read, per application and data set."""

    def get(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _STAGES:
            _STAGES[key] = build(spark, sf_dir)
        return _STAGES[key]

    return get


@contextmanager
def beyond_broadcast(spark):
    """Limits so small that the plans for large tables run on the test tables."""
    limits = {"broadcastBytes": "0", "blockRows": "100", "sliceRows": "50"}
    names = {f"spark.nearfield.{n}": v for n, v in limits.items()}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffled(name: str) -> None:
    """Register the query ``name`` once more, by the plans for tables above the broadcast limit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with beyond_broadcast(spark):
            return QUERIES[name](spark, sf_dir)

    QUERIES[f"{name}_shuffled"] = run


def points(spark, sf_dir) -> DataFrame:
    return T.read_points(spark, f"{sf_dir}/embeddings.parquet")


def queries_of(spark, sf_dir) -> DataFrame:
    return T.as_queries(points(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", F.col("embedding").alias("v"), "label")


def anchored(spark, sf_dir) -> DataFrame:
    """Every vector beside its label's first vector: ``vec_id, v, anchor, a``."""
    rows = labelled(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("vec_id").alias("anchor"))
    vectors = rows.select(F.col("vec_id").alias("anchor"), F.col("v").alias("a"))
    return rows.join(first.join(vectors, "anchor"), "label")


def six(*names) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@stage
def partition(spark, sf_dir):
    return R.build_partition(points(spark, sf_dir), P.CARVE, 2)


@stage
def deep_partition(spark, sf_dir):
    return R.build_partition(points(spark, sf_dir), P.DEEP, 2)


def leaves_of(spark, sf_dir) -> DataFrame:
    return partition(spark, sf_dir).leaves


def crowded(spark, sf_dir) -> DataFrame:
    """The points, every third one moved onto the first: groups that no leaders can split."""
    first = points(spark, sf_dir).filter("vec_id = 0").select(F.lit(0).alias("at"), F.col("v").alias("a"))
    moved = points(spark, sf_dir).withColumn("at", F.lit(0)).join(F.broadcast(first), "at")
    v = F.when(F.col("vec_id") % 3 == 0, F.col("a")).otherwise(F.col("v"))
    return moved.select("vec_id", v.alias("v"))


@stage
def crowded_partition(spark, sf_dir):
    return R.build_partition(crowded(spark, sf_dir), P.DEEP, 2)


@stage
def candidates(spark, sf_dir):
    built = C.build_candidates(points(spark, sf_dir), P.BUILD.candidates())
    built.edges = materialize(built.edges, "candidates")
    return built


@stage
def hash_graph(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    return materialize(H.hash_prune(edges, points(spark, sf_dir), P.PRUNE), "hash_graph")


@stage
def refined_graph(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    refined = H.refine_degree(edges, points(spark, sf_dir), P.PRUNE.max_degree)
    return materialize(refined, "refined_graph")


@stage
def truth(spark, sf_dir):
    base = points(spark, sf_dir)
    return materialize(N.ground_truth(base, T.as_queries(base), P.K), "truth")


@stage
def found(spark, sf_dir):
    result = S.beam_search(
        hash_graph(spark, sf_dir), points(spark, sf_dir), queries_of(spark, sf_dir), P.SEARCH
    )
    return materialize(result, "found")


# --- sources and sinks -------------------------------------------------------


def _vector_file(spark, sf_dir, kind) -> DataFrame:
    path = table_path(spark, kind)
    VF.write_vectors(points(spark, sf_dir), path, kind)
    read = {"fvecs": VF.read_fvecs, "fbin": VF.read_fbin}[kind](spark, path)
    return read.select(
        "vec_id", F.size("v").alias("dim"), F.round(V.norm2("v"), 6).alias("norm"),
        F.element_at("v", 1).cast("double").alias("first"),
    )


@query
def s1_read_fvecs(spark, sf_dir):
    return _vector_file(spark, sf_dir, "fvecs")


@query
def s3_read_fbin(spark, sf_dir):
    return _vector_file(spark, sf_dir, "fbin")


def _truth_file(spark, sf_dir, kind) -> DataFrame:
    path = table_path(spark, kind)
    lists = truth(spark, sf_dir).groupBy(F.col("query_id").alias("vec_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]
        ).alias("v")
    )
    VF.write_vectors(lists, path, kind)
    return VF.truth_rows({"ivecs": VF.read_ivecs, "ibin": VF.read_ibin}[kind](spark, path))


@query
def s2_read_ivecs(spark, sf_dir):
    return _truth_file(spark, sf_dir, "ivecs")


@query
def s4_read_ibin(spark, sf_dir):
    return _truth_file(spark, sf_dir, "ibin")


@query
def s5_read_vectors(spark, sf_dir):
    path = table_path(spark, "any")
    VF.write_vectors(points(spark, sf_dir), path, "fvecs")
    return VF.read_vectors(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("last_id"),
        F.max(F.size("v")).alias("dim"),
    )


@query
def s6_row_limit(spark, sf_dir):
    return T.first_rows(points(spark, sf_dir), P.ROW_LIMIT).select(
        "vec_id", F.round(V.norm2("v"), 6).alias("norm")
    )


@query
def s7_vector_file_inventory(spark, sf_dir):
    path = table_path(spark, "inventory")
    VF.write_vectors(points(spark, sf_dir), path, "fbin")
    return VF.vector_file_inventory(spark, [path]).groupBy("kind", "dim", "consistent").agg(
        F.sum("rows").alias("vectors"), F.sum(F.col("size") - 8).alias("payload_bytes")
    )


@query
def s8_synthetic_vectors(spark, sf_dir):
    made = T.synthetic_vectors(points(spark, sf_dir).select("vec_id"), 8, P.SYNTHETIC_SEED)
    return made.select("vec_id", F.posexplode("v").alias("axis", "x")).select(
        "vec_id", "axis", F.round("x", 6).alias("x")
    )


@query
def s9_table_source(spark, sf_dir):
    table = T.read_points(spark, f"{sf_dir}/embeddings.parquet", dim=P.DIM)
    return table.select(
        "vec_id", F.size("v").alias("dim"),
        F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda t, x: t + x), 6).alias("total"),
    )


@query
def s10_metrics_json(spark, sf_dir):
    path = table_path(spark, "metrics")
    IO.write_metrics(runs(spark, sf_dir).withColumn("mode", F.col("name")), path)
    return IO.read_metrics(spark, path).select("mode", *six("build_sec", "recall_at_10", "qps"), "edges")


@query
def s11_summary_tsv(spark, sf_dir):
    path = table_path(spark, "summary")
    named = runs(spark, sf_dir).select(
        F.concat_ws("@", "name", "scale").alias("name"), F.col("method").alias("mode"),
        "build_sec", "recall_at_10", "qps", "edges",
    )
    IO.write_summary(named, path)
    return IO.read_summary(spark, path).select(
        "name", "mode", *six("build_sec", "recall_at_10", "qps"), "edges"
    )


# --- vector functions --------------------------------------------------------


@query
def v1_l2_squared(spark, sf_dir):
    return anchored(spark, sf_dir).select(
        "vec_id", "anchor", F.round(V.l2_squared("v", "a"), 6).alias("d")
    )


@query
def v2_dot(spark, sf_dir):
    return anchored(spark, sf_dir).select("vec_id", "anchor", F.round(V.dot("v", "a"), 6).alias("p"))


@query
def v3_metric_score(spark, sf_dir):
    return anchored(spark, sf_dir).select(
        "vec_id",
        F.round(V.metric_score("v", "a", "l2"), 6).alias("l2"),
        F.round(V.metric_score("v", "a", "ip"), 6).alias("ip"),
    )


@query
def v4_dimension_guard(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("v", V.checked_vector("v", P.DIM))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(V.norm2("v")), 6).alias("norm")
    )


@query
def v5_clamp_distance(spark, sf_dir):
    shifted = F.round(V.dot("v", "a"), 6) / F.lit(10000.0) - F.lit(0.00005)
    return anchored(spark, sf_dir).select(
        "vec_id", F.round(V.clamp_distance(shifted), 9).alias("d")
    )


@query
def v6_l2_from_norms(spark, sf_dir):
    rows = anchored(spark, sf_dir).withColumn("na", V.norm2("v")).withColumn("nb", V.norm2("a"))
    d = V.l2_from_norms("v", "a", F.col("na"), F.col("nb"))
    return rows.select("vec_id", F.round(d, 6).alias("d"))


@query
def v7_residual_hash(spark, sf_dir):
    base = points(spark, sf_dir)
    steps = anchored(spark, sf_dir).select(F.col("anchor").alias("src"), F.col("vec_id").alias("dst"))
    return H.hash_edges(steps, base, P.PRUNE).select("src", "dst", "hash")


@query
def v7_residual_hash_equal(spark, sf_dir):
    """Every vector beside a copy of itself under another id: the residual is zero."""
    base = points(spark, sf_dir)
    other = -F.col("vec_id") - 1
    both = base.unionByName(base.withColumn("vec_id", other))
    steps = base.select(F.col("vec_id").alias("src"), other.alias("dst"))
    return H.hash_edges(steps, both, P.PRUNE).select("src", "dst", "hash")


@query
def v8_hyperplanes(spark, sf_dir):
    base = points(spark, sf_dir)
    planes = V.hyperplanes(P.PRUNE.hash_bits, P.DIM, P.PRUNE.seed)
    return H.project(base, planes).select("vec_id", F.posexplode("p").alias("bit", "x")).select(
        "vec_id", "bit", F.round("x", 6).alias("x")
    )


@query
def v9_qps(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spans = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("sec"),
    )
    return spans.select("event_type", F.col("day").cast("string").alias("day"),
                        F.round(V.qps("n", "sec"), 6).alias("qps"))


@query
def v10_valid_edges(spark, sf_dir):
    edges = labelled(spark, sf_dir).select(
        F.col("vec_id").alias("src"), (F.col("vec_id") * 2 - F.col("label") * 3).alias("dst")
    )
    return V.valid_edges(edges, points(spark, sf_dir))


# --- exact neighbours --------------------------------------------------------


@query
def k1_exact_topk_l2(spark, sf_dir):
    base = points(spark, sf_dir)
    return N.exact_topk(base, T.as_queries(base), P.K).select("query_id", "rank", "vec_id", *six("d"))


@query
def k1_exact_topk_ip(spark, sf_dir):
    base = points(spark, sf_dir)
    return N.exact_topk(base, T.as_queries(base), P.K, "ip").select(
        "query_id", "rank", "vec_id", *six("d")
    )


@query
def k1_exact_topk_blocked(spark, sf_dir):
    base = points(spark, sf_dir)
    found_rows = N.topk_join(T.as_queries(base), base, P.K, broadcast_bytes=0)
    return found_rows.select("query_id", "rank", "vec_id", *six("d"))


@query
def k2_exact_knn_graph(spark, sf_dir):
    return N.exact_knn_graph(points(spark, sf_dir), 8).select("src", "dst", "rank", *six("d"))


@query
def k3_ground_truth(spark, sf_dir):
    base = points(spark, sf_dir)
    return N.ground_truth(base, T.as_queries(base), P.K, "ip")


# --- partitioning ------------------------------------------------------------


@query
def p1_leader_count(spark, sf_dir):
    groups = labelled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("label", "n", R.leader_count("n", P.CARVE).alias("leaders"))


def _label_groups(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("path", F.concat(R.digits(F.lit(0)), R.digits("label")))
    return rows, rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query
def p2_sample_leaders(spark, sf_dir):
    rows, groups = _label_groups(spark, sf_dir)
    params = R.CarveParams(leader_frac=0.1, seed=17)
    chosen = R.sample_leaders(rows.select("path", "vec_id", "label"), groups, params)
    return chosen.select("label", "child", "vec_id")


@query
def p3_assign_to_leaders(spark, sf_dir):
    rows, groups = _label_groups(spark, sf_dir)
    params = R.CarveParams(leader_frac=0.1, seed=17)
    leaders, _ = R.leaders_of_level(rows.select("path", "vec_id"), points(spark, sf_dir), groups, params)
    return R.assign_to_leaders(rows, leaders).select("vec_id", "leader", "child", *six("d"))


@query
def p4_bucket_split(spark, sf_dir):
    rows, groups = _label_groups(spark, sf_dir)
    params = R.CarveParams(leader_frac=0.1, seed=17, cmax=16)
    leaders, _ = R.leaders_of_level(rows.select("path", "vec_id"), points(spark, sf_dir), groups, params)
    sizes = R.bucket_sizes(R.assign_to_leaders(rows, leaders), groups, params)
    return sizes.select(
        F.conv(F.substring("parent", 9, 8), 16, 10).cast("int").alias("label"),
        "child", "n", "representative", "fate",
    )


@query
def p5_carve(spark, sf_dir):
    forest = R.carve(points(spark, sf_dir), P.CARVE, 2)
    return forest.leaves.select(
        R.replica_of().alias("replica"),
        F.conv(F.substring("path", 9, 8), 16, 10).cast("bigint").alias("child"), "vec_id",
    )


@query
def p5_carve_deep(spark, sf_dir):
    nodes = deep_partition(spark, sf_dir).nodes
    return nodes.select("path", "parent", "representative", "is_leaf")


@query
def p5_carve_crowded(spark, sf_dir):
    """Carving where equal points force runs of ids."""
    nodes = crowded_partition(spark, sf_dir).nodes
    return nodes.select("path", "parent", "representative", "is_leaf", "chunked")


@query
def p6_chunk_split(spark, sf_dir):
    rows, _ = _label_groups(spark, sf_dir)
    runs_of = R.chunk_split(rows.select(F.col("path").alias("parent"), "vec_id"), 7)
    return runs_of.groupBy("parent", "path").agg(
        F.min("vec_id").alias("representative"), F.count(F.lit(1)).alias("n")
    ).select(
        F.conv(F.substring("parent", 9, 8), 16, 10).cast("int").alias("label"),
        F.conv(F.substring("path", 17, 8), 16, 10).cast("bigint").alias("chunk"),
        "representative", "n",
    )


@query
def p7_leaf_numbers(spark, sf_dir):
    nodes = partition(spark, sf_dir).nodes
    numbered = R.number_leaves(nodes).join(nodes.select("path", "representative"), "path")
    return numbered.select("replica", "leaf_id", "representative")


def root_picks(spark, sf_dir, base, nodes, count) -> DataFrame:
    """The ``count`` nearest children of every root: ``vec_id, path, rank``."""
    top = nodes.filter("length(path) = 16")
    reps = top.join(base.withColumnRenamed("vec_id", "representative"), "representative")
    start = base.withColumn("parent", F.explode(F.array(F.lit("00000000"), F.lit("00000001"))))
    return R.nearest_children(start, reps, count)


@query
def p8_nearest_children(spark, sf_dir):
    picks = root_picks(spark, sf_dir, points(spark, sf_dir), partition(spark, sf_dir).nodes, 3)
    return picks.select(
        R.replica_of().alias("replica"), "vec_id", "rank",
        F.conv(F.substring("path", 9, 8), 16, 10).cast("bigint").alias("child"),
    )


def _routed(spark, sf_dir, base, nodes) -> DataFrame:
    depth = nodes.agg(F.max(F.length("path")) / 8 - 1).first()[0]
    routed = R.route_to_leaf(root_picks(spark, sf_dir, base, nodes, 3), base, nodes, int(depth))
    return routed.select("vec_id", R.replica_of().alias("replica"), "rank", "path")


@query
def p9_route_to_leaf(spark, sf_dir):
    """Every point from its three nearest children of the root down to a leaf."""
    return _routed(spark, sf_dir, points(spark, sf_dir), deep_partition(spark, sf_dir).nodes)


@query
def p9_route_crowded(spark, sf_dir):
    return _routed(spark, sf_dir, crowded(spark, sf_dir), crowded_partition(spark, sf_dir).nodes)


@query
def p9_route_at_leaf(spark, sf_dir):
    nodes = partition(spark, sf_dir).nodes
    leaves = nodes.filter("is_leaf").select("path", F.col("representative").alias("vec_id"))
    routed = R.route_to_leaf(leaves, points(spark, sf_dir), nodes, 1)
    return routed.select(
        R.replica_of().alias("replica"),
        F.conv(F.substring("path", 9, 8), 16, 10).cast("bigint").alias("child"), "vec_id",
    )


@query
def p10_overlap(spark, sf_dir):
    return partition(spark, sf_dir).leaves.select("replica", "leaf_id", "vec_id")


@query
def p11_point_memberships(spark, sf_dir):
    return R.point_memberships(partition(spark, sf_dir).leaves).select(
        "replica", "vec_id", F.array_join("leaf_ids", ",").alias("leaf_ids")
    )


@query
def p12_partition_stats(spark, sf_dir):
    return R.partition_stats(partition(spark, sf_dir))


@query
def p13_build_partition(spark, sf_dir):
    built = R.build_partition(points(spark, sf_dir), P.CARVE, 1)
    return built.leaves.groupBy("leaf_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first_id"), F.sum("vec_id").alias("id_sum")
    )


@query
def p13_build_partition_deep(spark, sf_dir):
    return R.partition_stats(deep_partition(spark, sf_dir))


@query
def p13_build_partition_crowded(spark, sf_dir):
    return R.partition_stats(crowded_partition(spark, sf_dir))


# --- candidates --------------------------------------------------------------


@query
def c1_shortlist(spark, sf_dir):
    return C.shortlist_rows(C.shortlist(leaves_of(spark, sf_dir))).select("replica", "src", "rank", "dst")


@query
def c2_cap_shortlist(spark, sf_dir):
    return C.shortlist_rows(C.shortlist(leaves_of(spark, sf_dir), 128)).select("replica", "src", "rank", "dst")


@query
def c3_score_shortlist(spark, sf_dir):
    scored = C.score_shortlist(points(spark, sf_dir), leaves_of(spark, sf_dir), 12, 128)
    return scored.select("replica", "src", "dst", "rank", *six("d"))


@query
def c3_score_uncapped_ip(spark, sf_dir):
    scored = C.score_shortlist(points(spark, sf_dir), leaves_of(spark, sf_dir), 12, 0, "ip")
    return scored.select("replica", "src", "dst", "rank", *six("d"))


@query
def c4_bidirect(spark, sf_dir):
    scored = C.score_shortlist(points(spark, sf_dir), leaves_of(spark, sf_dir), 4, 128)
    both = C.bidirect(scored.select("replica", "src", "dst", "d"))
    return both.select("replica", "src", "dst", *six("d"))


@query
def c5_union_replicas(spark, sf_dir):
    built = C.build_candidates(points(spark, sf_dir), P.REPLICATED.candidates())
    return built.edges.select("src", "dst", *six("d"))


@query
def c6_candidate_stats(spark, sf_dir):
    return C.candidate_stats(C.build_candidates(points(spark, sf_dir), P.REPLICATED.candidates()))


@query
def c7_leaf_knn_exact(spark, sf_dir):
    edges = L.leaf_knn_exact(points(spark, sf_dir), leaves_of(spark, sf_dir), 6, bidirected=True)
    return edges.select("replica", "leaf_id", "src", "dst", *six("d"))


@query
def c8_leaf_knn_capped(spark, sf_dir):
    edges = L.leaf_knn_capped(points(spark, sf_dir), leaves_of(spark, sf_dir), 4, P.SCAN_CAP)
    return edges.select("replica", "leaf_id", "src", "dst", *six("d"))


@query
def c9_leaf_knn_blocked(spark, sf_dir):
    edges = L.leaf_knn_blocked(points(spark, sf_dir), leaves_of(spark, sf_dir), 6)
    return edges.select("replica", "leaf_id", "src", "dst")


# --- graphs ------------------------------------------------------------------


@query
def g1_hash_prune(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    pruned = H.hash_prune(edges, points(spark, sf_dir), P.PRUNE)
    return pruned.select("src", "dst", "rank", *six("d"))


@query
def g2_prune_counters(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    return H.prune_counters(edges, points(spark, sf_dir), P.PRUNE)


@query
def g3_prune_totals(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    return H.prune_totals(H.prune_counters(edges, points(spark, sf_dir), P.PRUNE))


@query
def g4_refine_degree(spark, sf_dir):
    edges = candidates(spark, sf_dir).edges
    refined = H.refine_degree(edges.select("src", "dst"), points(spark, sf_dir), 8, "ip")
    return refined.select("src", "dst", "rank", *six("d"))


@query
def g5_build_graph_hashprune(spark, sf_dir):
    graph = B.build_graph_hashprune(points(spark, sf_dir), P.REPLICATED)
    return graph.select("src", "dst", "rank", *six("d"))


@query
def g6_build_graph_refined(spark, sf_dir):
    graph = B.build_graph_refined(points(spark, sf_dir), P.BUILD.with_metric("ip"))
    return graph.select("src", "dst", "rank", *six("d"))


@query
def g7_build_graph_exact(spark, sf_dir):
    graph = B.build_graph_exact(points(spark, sf_dir), P.BUILD)
    return graph.select("src", "dst", "rank", *six("d"))


@query
def g8_adjacency(spark, sf_dir):
    lists = G.adjacency(hash_graph(spark, sf_dir), points(spark, sf_dir))
    return lists.select("src", F.array_join("nbrs", ",").alias("nbrs"), F.size("nbrs").alias("degree"))


@query
def g8_edge_count(spark, sf_dir):
    edges = G.edge_count(hash_graph(spark, sf_dir))
    return edges.join(F.broadcast(G.num_nodes(points(spark, sf_dir))), F.lit(True))


# --- search and evaluation ---------------------------------------------------


@query
def q1_beam_search(spark, sf_dir):
    return found(spark, sf_dir).select("query_id", "rank", "vec_id", *six("d"))


@query
def q1_beam_search_repeated(spark, sf_dir):
    """The same search where every edge is listed twice."""
    edges = hash_graph(spark, sf_dir)
    hits = S.beam_search(
        edges.unionByName(edges), points(spark, sf_dir), queries_of(spark, sf_dir), P.SEARCH
    )
    return hits.select("query_id", "rank", "vec_id", *six("d"))


@query
def q1_beam_search_short(spark, sf_dir):
    """A beam of few expansions over twice-listed edges; in rounds, every expansion is a join."""
    edges = hash_graph(spark, sf_dir)
    hits = S.beam_search(
        edges.unionByName(edges), points(spark, sf_dir), queries_of(spark, sf_dir), P.SHORT_SEARCH
    )
    return hits.select("query_id", "rank", "vec_id", *six("d"))


@query
def q2_search_refined_graph(spark, sf_dir):
    hits = S.search_refined_graph(
        refined_graph(spark, sf_dir), points(spark, sf_dir), queries_of(spark, sf_dir), P.SEARCH
    )
    return hits.select("query_id", "rank", "vec_id", *six("d"))


@query
def q3_approx_baseline(spark, sf_dir):
    hits = approx_baseline(points(spark, sf_dir), queries_of(spark, sf_dir), P.K)
    return hits.select("query_id", "rank", "vec_id", *six("d"))


@query
def q3_cell_index(spark, sf_dir):
    """What the stored index says of itself, and the recall of all queries by it."""
    base, asked = points(spark, sf_dir), queries_of(spark, sf_dir)
    path = table_path(spark, "index")
    build_cell_index(base, asked, P.K, path)
    index = open_cell_index(spark, path)
    recall = E.recall_at_k(truth(spark, sf_dir), probe_cells(index, asked, P.K), P.K)
    rows = index.about.join(F.broadcast(recall.select(F.col("recall").alias("recall_of_all"))), F.lit(True))
    return rows.select(
        "cells", "probes", "shortlist", "points", *six("recall", "read", "compared", "recall_of_all")
    )


@query
def e1_recall_at_k(spark, sf_dir):
    return E.recall_at_k(truth(spark, sf_dir), found(spark, sf_dir), P.K).select(*six("recall"))


@query
def e2_recall_micro(spark, sf_dir):
    base = points(spark, sf_dir)
    wide = N.ground_truth(base, T.as_queries(base), 3 * P.K)
    return E.recall_micro(wide, found(spark, sf_dir), P.K).select(*six("recall"))


@query
def e3_evaluate_graph(spark, sf_dir):
    scored = B.evaluate_graph(
        hash_graph(spark, sf_dir), points(spark, sf_dir), queries_of(spark, sf_dir), P.SEARCH
    )
    return scored.select(*six("recall_at_10"), "edges")


@query
def e3_run_benchmark(spark, sf_dir):
    measured = B.run_benchmark(
        points(spark, sf_dir), queries_of(spark, sf_dir), "hash", P.BUILD, P.SEARCH
    )
    return measured.select("mode", *six("recall_at_10"), "edges")


@query
def e3_run_benchmark_cells(spark, sf_dir):
    """The benchmark entry over the approximate index, with its micro recall and entries."""
    measured = B.run_benchmark(
        points(spark, sf_dir), queries_of(spark, sf_dir), "cells", P.BUILD, P.SEARCH
    )
    return measured.select("mode", *six("recall_at_10"), "edges")


@query
def e4_build_profile(spark, sf_dir):
    return B.build_profile(points(spark, sf_dir), P.BUILD).counters


@query
def e5_parameter_sweep(spark, sf_dir):
    swept = X.parameter_sweep(
        points(spark, sf_dir), queries_of(spark, sf_dir), P.SWEEP, P.CARVE, 1, P.PRUNE, P.SEARCH
    )
    return swept.select("name", "mode", *six("recall_at_10"), "edges")


@query
def s11_sweep_summary(spark, sf_dir):
    """A sweep written as the summary of its runs and read back, without the seconds."""
    path = table_path(spark, "sweep-summary")
    swept = X.parameter_sweep(
        points(spark, sf_dir), queries_of(spark, sf_dir), P.SWEEP, P.CARVE, 1, P.PRUNE, P.SEARCH
    )
    IO.write_summary(swept, path)
    return IO.read_summary(spark, path).select("name", "mode", *six("recall_at_10"), "edges")


@stage
def runs(spark, sf_dir) -> DataFrame:
    """One run per configuration and label, scored on the graph's own lists.

    Wall-clock seconds differ from run to run, so counts of work stand in for
    them: scored candidates for the build, edges for a query.
    """
    base = points(spark, sf_dir)
    graphs = X.sweep_graphs(base, P.RUNS, P.CARVE, 1, P.PRUNE)
    labels = labelled(spark, sf_dir).select("vec_id", "label")
    exact = N.topk_join(T.as_queries(base), base, P.K, exclude_self=True).select(
        F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.lit(1).alias("hit")
    )
    per_label = (
        graphs.join(exact, ["src", "dst"], "left")
        .join(labels.withColumnRenamed("vec_id", "src"), "src")
        .groupBy("graph_id", "label")
        .agg(F.count(F.lit(1)).alias("edges"), F.sum("hit").alias("hits"))
        .join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    )
    table = spark.createDataFrame(
        [(i, c.name, c.mode, c.leaf_k) for i, c in enumerate(P.RUNS)],
        "graph_id int, name string, method string, leaf_k int",
    )
    rows = per_label.join(F.broadcast(table), "graph_id").select(
        "name", "method", F.col("label").cast("string").alias("scale"),
        (F.col("leaf_k") * F.col("n") / 1000.0).alias("build_sec"),
        F.round(F.col("hits") / (F.col("n") * float(P.K)), 6).alias("recall_at_10"),
        F.round(1e6 / F.col("edges"), 6).alias("qps"),
        "edges",
    )
    return materialize(rows, "runs")


@query
def e6_rank_runs(spark, sf_dir):
    return X.rank_runs(runs(spark, sf_dir)).select("scale", "name", "position")


@query
def e7_recall_gate(spark, sf_dir):
    return X.recall_gate(runs(spark, sf_dir), 0.7).select("scale", "name", "passed", "first_passing")


@query
def e8_recall_matched(spark, sf_dir):
    matched = X.recall_matched(runs(spark, sf_dir), "refined", "hash")
    return matched.select("scale", "name", "partner", *six("build_ratio", "qps_ratio"))


@query
def e9_config_delta(spark, sf_dir):
    changed = X.config_delta(runs(spark, sf_dir), "refined_k12")
    return changed.select("scale", "name", *six(*[c for c in changed.columns if c[-4:] in ("elta", "_pct")]))


@query
def e10_reconcile_runs(spark, sf_dir):
    recorded = runs(spark, sf_dir).select(
        F.concat_ws("@", "name", "scale").alias("name"), F.col("method").alias("mode"), "scale",
        "build_sec", "recall_at_10", "qps", "edges",
    )
    number = F.col("scale").cast("int")
    measured = recorded.filter(number != 1).select(
        "name", F.when(number == 2, "other").otherwise(F.col("mode")).alias("mode"),
        F.when(number != 3, F.col("build_sec")).alias("build_sec"),
        F.when(number == 4, F.col("recall_at_10") + 1e-12).otherwise(F.col("recall_at_10")).alias("recall_at_10"),
        "qps", F.when(number == 5, F.col("edges") + 1).otherwise(F.col("edges")).alias("edges"),
    )
    manifest = recorded.filter(number != 6).drop("scale")
    return X.reconcile_runs(manifest, measured).select("name", "metric", "status")


# --- the same results by the plans for large tables --------------------------

SHUFFLED = (
    "k1_exact_topk_l2", "k1_exact_topk_ip", "k2_exact_knn_graph", "k3_ground_truth",
    "p3_assign_to_leaders", "p4_bucket_split", "c2_cap_shortlist", "c3_score_shortlist",
    "c5_union_replicas", "c8_leaf_knn_capped", "g4_refine_degree", "q1_beam_search_short",
    "q3_approx_baseline",
)
for _name in SHUFFLED:
    shuffled(_name)
