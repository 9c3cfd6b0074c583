import numpy as np
import pytest

from nearfield.operators.evaluate import recall_at_k
from nearfield.operators.knn import ground_truth
from nearfield.operators.prune import refine_degree
from nearfield.operators.candidates import build_candidates
from nearfield.operators.search import beam_search
from nearfield.params import BuildParams, CarveParams, CarveRoots, PruneParams, SearchParams
from nearfield.plans import experiments as X
from nearfield.plans.build import build_graph
from nearfield.runtime import table_path
from nearfield.sources.results import read_summary, write_summary
from tests.model import close, frame

# Published rows of a parameter sweep: name, build seconds, recall, queries per second, edges.
SWEEP = [
    ("m16_efs32", 160.07, 0.965, 328.292, 320000), ("m16_efs28", 154.722, 0.956, 379.074, 320000),
    ("m16_efs24", 153.894, 0.944, 425.288, 320000), ("m12_efs24", 134.862, 0.923, 402.554, 240000),
    ("m16_efs16", 155.92, 0.916, 543.905, 320000), ("m8_efs24", 98.0136, 0.890, 674.155, 160000),
    ("m12_efs16", 126.709, 0.860, 659.781, 240000), ("m16_efs8", 176.732, 0.859, 682.063, 320000),
    ("m8_efs16", 94.3867, 0.858, 899.365, 160000), ("m12_efs8", 127.963, 0.809, 816.767, 240000),
    ("m8_efs8", 93.7419, 0.766, 1130.11, 160000),
]
GRAPH = [
    ("k12", 245.748, 0.939, 62.9043, 327697), ("k16", 281.981, 0.944, 54.1159, 413032),
    ("k20", 287.254, 0.952, 47.7327, 491752),
]
SCHEMA = ("name string, method string, scale string, build_sec double, recall_at_10 double, "
          "qps double, edges bigint")


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(n, "baseline", "20k", b, r, q, e) for n, b, r, q, e in SWEEP]
    rows += [(n, "graph", "20k", b, r, q, e) for n, b, r, q, e in GRAPH]
    return spark.createDataFrame(rows, SCHEMA)


def test_ranking_follows_the_published_order(runs):
    ranked = X.rank_runs(runs.filter("method = 'baseline'")).collect()
    assert [r["name"] for r in sorted(ranked, key=lambda r: r["position"])] == [s[0] for s in SWEEP]


def test_gate(runs):
    gated = X.recall_gate(runs.filter("method = 'graph'")).collect()
    assert {r["name"]: r["passed"] for r in gated} == {"k12": False, "k16": False, "k20": True}
    assert {r["first_passing"] for r in gated} == {"k20"}
    none = X.recall_gate(runs, 0.999).collect()
    assert {r["first_passing"] for r in none} == {None} and len(none) == 14


def test_nearest_recall(runs):
    matched = {r["name"]: r for r in X.recall_matched(runs, "graph", "baseline").collect()}
    assert matched["k20"]["partner"] == "m16_efs28" and matched["k16"]["partner"] == "m16_efs24"
    assert abs(matched["k20"]["build_ratio"] - 1.86) < 0.01
    assert abs(matched["k20"]["qps_ratio"] - 7.94) < 0.01


def test_delta(runs):
    changed = {r["name"]: r for r in X.config_delta(runs, "k16").collect()}
    assert close(changed["k20"]["build_sec_delta"], 5.273, 1e-6)
    assert close(changed["k20"]["recall_at_10_delta"], 0.008, 1e-6)
    assert "k16" not in changed


def test_reconcile(spark):
    schema = "name string, mode string, build_sec double, recall_at_10 double, qps double, edges bigint"
    recorded = [("a", "hash", 1.0, 0.9, 10.0, 5), ("b", "hash", 2.0, 0.9, 10.0, 5),
                ("c", "hash", 3.0, None, 10.0, 5), ("d", "hash", 1.0, 0.9, 10.0, 5)]
    measured = [("a", "hash", 1.0 + 1e-12, 0.9, 10.0, 5), ("b", "exact", 2.1, 0.9, 10.0, 6),
                ("c", "hash", 3.0, 0.9, 10.0, 5)]
    found = X.reconcile_runs(spark.createDataFrame(recorded, schema), spark.createDataFrame(measured, schema))
    got = {(r["name"], r["metric"], r["status"]) for r in found.collect()}
    assert got == {("b", "mode", "mismatch"), ("b", "build_sec", "mismatch"), ("b", "edges", "mismatch"),
                   ("c", "recall_at_10", "missing_field")} | {
        ("d", m, "missing_result") for m in ("mode", "build_sec", "recall_at_10", "qps", "edges")}


def test_sweep_equals_single_builds(spark):
    rng = np.random.default_rng(13)
    points = frame(spark, rng.normal(size=(120, 4)))
    queries = points.withColumnRenamed("vec_id", "query_id")
    carve, search = CarveParams(cmax=24, leader_frac=0.1), SearchParams(topk=5)
    configs = [X.SweepConfig("a", leaf_k=3, max_degree=6, beam=12),
               X.SweepConfig("b", leaf_k=6, max_degree=6, beam=20)]
    swept = {r["name"]: r for r in X.parameter_sweep(points, queries, configs, carve, search=search).collect()}
    truth = ground_truth(points, queries, 5)
    for config in configs[1:]:
        build = BuildParams(carve, PruneParams(max_degree=6), leaf_k=config.leaf_k)
        edges = refine_degree(build_candidates(points, build.candidates()).edges, points, 6)
        found = beam_search(edges, points, queries, SearchParams(beam=config.beam, topk=5))
        assert close(recall_at_k(truth, found, 5).first()["recall"], swept[config.name]["recall_at_10"])
        assert edges.count() == swept[config.name]["edges"]


def test_sweep_over_all_axes(spark):
    """Settings of the partition, replicas, bits, lengths and modes, each graph as if built alone."""
    rng = np.random.default_rng(5)
    points = frame(spark, np.concatenate([rng.normal(size=(150, 5)), np.ones((30, 5))]))
    deep = CarveParams(cmax=12, leader_frac=0.03, fanout=3, seed=3)
    flat = CarveParams(cmax=500, fanout=2, seed=4)
    configs = [
        X.SweepConfig("deep", 4, 5, 9, "hash", deep, 2, 3), X.SweepConfig("flat", 6, 5, 9, "hash", flat, 1, 9),
        X.SweepConfig("shorter", 6, 2, 9, "hash", deep, 1, 9), X.SweepConfig("shared", 3, 5, 9, "refined", deep, 2),
        X.SweepConfig("plain", 5, 4, 9),
    ]
    carve, prune = CarveParams(cmax=40, leader_frac=0.1, max_leaders=7), PruneParams(hash_bits=4, seed=2)
    built = X.build_sweep(points, configs, carve, 1, prune)
    got = {}
    for row in built.edges.collect():
        got.setdefault(row["graph_id"], set()).add((row["src"], row["dst"], row["rank"], round(row["d"], 9)))
    for number, c in enumerate(configs):
        bits = prune.hash_bits if c.hash_bits is None else c.hash_bits
        params = BuildParams(c.carve or carve, PruneParams(bits, c.max_degree, 2), c.replicas or 1, c.leaf_k)
        alone = build_graph(points, c.mode, params).collect()
        assert got[number] == {(r["src"], r["dst"], r["rank"], round(r["d"], 9)) for r in alone}, c.name
    assert {r["graph_id"] for r in built.work.collect()} == set(range(5))


def test_sweep_feeds_summary_ranking_and_gate(spark):
    points = frame(spark, np.random.default_rng(8).normal(size=(300, 4)))
    queries = points.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    swept = X.parameter_sweep(points, queries, X.TUNING_GRID, search=SearchParams(topk=10), scale="300")
    path = table_path(spark, "summary")
    write_summary(swept, path)
    rows = {r["name"]: r for r in read_summary(spark, path).collect()}
    assert set(rows) == {c.name for c in X.TUNING_GRID}
    assert all(r["build_sec"] > 0 and r["qps"] > 0 and 0 <= r["recall_at_10"] <= 1 for r in rows.values())
    # The finest carving of such a small set is the least connected, the widest one the best.
    assert rows["quality_b"]["recall_at_10"] >= 0.95
    gated = X.recall_gate(swept).filter("passed").collect()
    assert {r["name"] for r in gated} >= {"quality_b"} and len(X.rank_runs(swept).collect()) == 6


def test_sweep_rejects_what_it_cannot_build():
    with pytest.raises(ValueError):
        X.SweepConfig("x", mode="exact")
    with pytest.raises(ValueError):
        CarveRoots(((CarveParams(), 0), (CarveParams(metric="ip"), 0)))
