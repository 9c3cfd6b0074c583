import numpy as np
import pytest

from nearfield.operators import candidates as C
from nearfield.operators.leafknn import leaf_knn_blocked, leaf_knn_capped, leaf_knn_exact
from nearfield.params import CandidateParams, CarveParams
from tests.model import frame, partition, score, shortlist


def leaf_table(spark, leaves):
    rows = [(0, n, i) for n, leaf in enumerate(leaves) for i in leaf]
    return spark.createDataFrame(rows, "replica int, leaf_id bigint, vec_id bigint")


def listed(df):
    return {r["vec_id"]: r["ids"] for r in df.collect()}


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_shortlist_order_and_cap(spark, paths):
    leaves = leaf_table(spark, [[0, 1, 2], [2, 3, 4], [0, 4, 5]])
    assert listed(C.shortlist(leaves, 3))[2] == [0, 1, 3]
    whole = listed(C.shortlist(leaves))
    assert whole[2] == [0, 1, 3, 4] and 9 not in whole
    rows = C.shortlist_rows(C.shortlist(leaves, 3)).filter("src = 2").collect()
    assert sorted((r["rank"], r["dst"]) for r in rows) == [(1, 0), (2, 1), (3, 3)]


def test_hot_leaf_lists_match_model(spark, paths):
    rng = np.random.default_rng(6)
    leaves = [sorted(rng.choice(60, size=n, replace=False).tolist()) for n in (40, 9, 5, 25)]
    table = leaf_table(spark, leaves)
    got = listed(C.shortlist(table, 7))
    assert got == {i: shortlist(leaves, i, 7) for i in {j for leaf in leaves for j in leaf}}


def test_listing_all_pairs_of_a_leaf(spark):
    leaves = leaf_table(spark, [list(range(30))])
    assert listed(C.shortlist(leaves))[3] == [i for i in range(30) if i != 3]
    assert listed(C.shortlist(leaves, 2))[3] == [0, 1]


def test_score_shortlist(spark, paths):
    points = frame(spark, [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [4.0, 0.0]])
    leaves = leaf_table(spark, [[0, 1, 2, 3]])
    for cap in (0, 3):
        best = C.score_shortlist(points, leaves, 2, cap).filter("src = 1")
        assert pairs(best) == [(1, 0), (1, 2)]
    both = pairs(C.bidirect(best.select("src", "dst")))
    assert both == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert C.score_shortlist(points, leaves, 0, 3).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_scores_of_overlapping_leaves_match_model(spark, paths, metric):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(50, 3)).astype("float32")
    vectors[10:28] = vectors[2]
    leaves = [list(range(0, 35)), list(range(20, 50)), [0, 5, 40]]
    for cap in (0, 9):
        got = {}
        for r in C.score_shortlist(frame(spark, vectors), leaf_table(spark, leaves), 4, cap, metric).collect():
            got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
        for i in range(50):
            near = sorted((score(vectors[i], vectors[j], metric), j) for j in shortlist(leaves, i, cap))
            assert [got[i][n] for n in sorted(got[i])] == [j for _, j in near[:4]]


def test_candidates_of_replicas(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(120, 4)).astype("float32")
    points, params = frame(spark, vectors), CarveParams(cmax=30, leader_frac=0.1, seed=11)
    settings = CandidateParams(params, replicas=2, leaf_k=5, cap=30)
    built = C.build_candidates(points, settings)
    expected, raw = set(), 0
    lookup = dict(enumerate(vectors))
    stats = {"num_leaves": 0, "partition_assignment_total": 0, "partition_min_leaf_size": 99, "partition_max_leaf_size": 0}
    for replica in range(2):
        leaves = partition(lookup, params, replica)
        stats["num_leaves"] += len(leaves)
        stats["partition_assignment_total"] += sum(map(len, leaves))
        stats["partition_min_leaf_size"] = min(stats["partition_min_leaf_size"], *map(len, leaves))
        stats["partition_max_leaf_size"] = max(stats["partition_max_leaf_size"], *map(len, leaves))
        for i in range(120):
            near = sorted((score(vectors[i], vectors[j]), j) for j in shortlist(leaves, i, 30))[:5]
            raw += 2 * len(near)
            expected |= {(i, j) for _, j in near} | {(j, i) for _, j in near}
    assert pairs(built.edges) == sorted(expected)
    row = C.candidate_stats(built).first().asDict()
    assert row["candidate_edges"] == raw
    assert {k: row[k] for k in stats} == stats


def test_directed_candidates_are_one_way(spark):
    points = frame(spark, [[0.0], [10.0], [11.0]])
    settings = CandidateParams(CarveParams(cmax=3), leaf_k=1, bidirected=False)
    edges = pairs(C.build_candidates(points, settings).edges)
    assert edges == [(0, 1), (1, 2), (2, 1)]


def test_leaf_knn(spark, paths):
    points = frame(spark, [[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]])
    edges = pairs(leaf_knn_exact(points, leaf_table(spark, [[0, 1, 2]]), 1, bidirected=True))
    assert (0, 1) in edges and (1, 0) in edges and all(a != b for a, b in edges)


def test_blocked_leaf_knn_stays_in_the_leaf(spark):
    points = frame(spark, [[0.0], [1.0], [3.0], [10.0], [20.0], [21.0], [22.5], [30.0]])
    leaves = leaf_table(spark, [[0, 1, 2, 3], [4, 5, 6, 7]])
    blocked = pairs(leaf_knn_blocked(points, leaves, 2))
    assert blocked == pairs(leaf_knn_exact(points, leaves, 2))
    assert all((a < 4) == (b < 4) for a, b in blocked)


def test_capped_leaf_scan(spark):
    points = frame(spark, [[0.0], [100.0], [1.0], [2.0]])
    leaves = leaf_table(spark, [[0, 1, 2, 3]])
    assert pairs(leaf_knn_capped(points, leaves, 1, 1)) == [(0, 1), (1, 2), (2, 3), (3, 0)]
    assert pairs(leaf_knn_capped(points, leaves, 1, 3)) == [(0, 2), (1, 3), (2, 0), (3, 2)]
    assert leaf_knn_capped(points, leaves, 0, 1).count() == 0


def test_capped_leaf_scan_matches_model(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(23, 2)).astype("float32")
    leaf, m, cap = list(range(23)), 23, 6
    expected = []
    for p in range(m):
        start = (p * 2654435761 % 2**32) % m
        seen = [leaf[(start + s) % m] for s in range(m)]
        seen = [v for v in seen if v != p][:cap]
        near = sorted((score(vectors[p], vectors[v]), v) for v in seen)[:3]
        expected += [(p, v) for _, v in near]
    got = pairs(leaf_knn_capped(frame(spark, vectors), leaf_table(spark, [leaf]), 3, cap))
    assert got == sorted(expected)
