import numpy as np
import pytest

from nearfield.operators import prune as H
from nearfield.operators.graph import adjacency, edge_count
from nearfield.params import PruneParams
from tests.model import bucket_scan, frame, score

COUNTS = ["kept", "replaced", "evicted", "dropped"]


def edges_of(spark, src, targets):
    return spark.createDataFrame([(src, t) for t in targets], "src bigint, dst bigint")


def kept(df, src=0):
    rows = df.filter(df.src == src).collect()
    return [r["dst"] for r in sorted(rows, key=lambda r: r["rank"])]


def test_one_bucket(spark):
    points = frame(spark, [[0, 0], [1, 0], [0, 1], [2, 0], [0, 2], [3, 3]])
    params = PruneParams(hash_bits=0, max_degree=2)
    edges = edges_of(spark, 0, [0, 5, 1, 3])
    assert kept(H.hash_prune(edges, points, params)) == [1]
    row = H.prune_counters(edges, points, params).first()
    # In id order: 1 enters, 3 and 5 are farther.
    assert (row["self_skipped"], row["kept"], row["dropped"], row["final_degree"]) == (1, 1, 2, 1)


def test_tie_goes_to_the_smaller_id(spark):
    points = frame(spark, [[0.0], [1.0], [-1.0]])
    params = PruneParams(hash_bits=0, max_degree=1)
    assert kept(H.hash_prune(edges_of(spark, 0, [2, 1]), points, params)) == [1]


def test_two_planes(spark):
    points = frame(spark, [[0, 0], [1, 1], [-2, 1], [1, -1], [-3, -3]])
    params, planes = PruneParams(hash_bits=2, max_degree=2), [[1.0, 0.0], [0.0, 1.0]]
    edges = edges_of(spark, 0, [4, 2, 3, 1])
    assert kept(H.hash_prune(edges, points, params, planes)) == [1, 3]
    row = H.prune_counters(edges, points, params, planes).first()
    assert [row[c] for c in COUNTS] == [3, 0, 1, 1]


def test_no_degree(spark):
    points = frame(spark, [[0.0], [1.0]])
    params, edges = PruneParams(max_degree=0), edges_of(spark, 0, [0, 1])
    assert H.hash_prune(edges, points, params).count() == 0
    row = H.prune_counters(edges, points, params).first()
    assert (row["self_skipped"], row["dropped"], row["kept"]) == (1, 1, 0)


@pytest.mark.parametrize("parts", [1, 6])
def test_hub_matches_sequential_scan(spark, parts):
    """One source holds most candidates and is cut into several pieces."""
    rng = np.random.default_rng(10)
    n = 400
    vectors = np.round(rng.normal(size=(n, 3)), 1).astype("float32")
    vectors[100:180] = vectors[7]
    pairs = [(0, j) for j in range(n)] + [(i, int(j)) for i in range(1, 40) for j in rng.choice(n, 6, False)]
    points = frame(spark, vectors)
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    params = PruneParams(hash_bits=5, max_degree=6, seed=3)
    hashed = H.hash_edges(H.score_edges(edges, points), points, params).collect()
    rows = {}
    for r in sorted(hashed, key=lambda r: r["dst"]):
        if r["dst"] != r["src"]:
            rows.setdefault(r["src"], []).append((r["d"], r["dst"], r["hash"]))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["src"]: r for r in H.prune_counters(edges, points, params).collect()}
        graph = H.hash_prune(edges, points, params).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lists = {}
    for r in sorted(graph, key=lambda r: r["rank"]):
        lists.setdefault(r["src"], []).append(r["dst"])
    for src, scan in rows.items():
        counts, final = bucket_scan(scan, 6)
        assert tuple(got[src][c] for c in COUNTS) == counts
        assert lists[src] == final and got[src]["final_degree"] == len(final)
    totals = H.prune_totals(H.prune_counters(edges, points, params)).first()
    assert totals["prune_final_edges"] == len(graph)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_refine_degree(spark, metric):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(12, 3)).astype("float32")
    pairs = [(i, j) for i in range(12) for j in (*range(12), -1, 50)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    refined = H.refine_degree(edges, frame(spark, vectors), 3, metric)
    for i in range(12):
        near = sorted((score(vectors[i], vectors[j], metric), j) for j in range(12) if j != i)
        assert kept(refined, i) == [j for _, j in near[:3]]


def test_adjacency_keeps_lonely_nodes(spark):
    points = frame(spark, [[0.0], [1.0], [2.0]])
    edges = spark.createDataFrame([(0, 2, 1), (0, 1, 2)], "src bigint, dst bigint, rank int")
    lists = {r["src"]: r["nbrs"] for r in adjacency(edges, points).collect()}
    assert lists == {0: [2, 1], 1: [], 2: []}
    assert edge_count(edges).first()["edges"] == 2


def test_too_many_bits():
    with pytest.raises(ValueError):
        PruneParams(hash_bits=64)


def test_equal_vectors_have_equal_projections_in_any_batch(spark):
    rng = np.random.default_rng(8)
    vector = rng.normal(size=96).tolist()
    rows = [(i, vector if i % 7 == 0 else rng.normal(size=96).tolist()) for i in range(200)]
    points = spark.createDataFrame(rows, "vec_id bigint, v array<double>").repartition(5)
    params = PruneParams(hash_bits=12)
    edges = edges_of(spark, 0, [i for i in range(7, 200, 7)])
    codes = H.hash_edges(edges, points, params, H.plane_set(points, params)).collect()
    assert len(codes) == 28 and {r["hash"] for r in codes} == {2**12 - 1}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_scores_of_edges(spark, paths, metric):
    """Edges with repeats, one source with very many targets, self edges and ids without a vector."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(90, 3))
    points = frame(spark, vectors)
    edges = [(int(a), int(b), int(a + b)) for a, b in rng.integers(0, 90, (300, 2))]
    edges += [(7, i, 1) for i in range(90)] + [(3, 400, 0), (400, 3, 0), edges[0]]
    scored = H.score_edges(spark.createDataFrame(edges, "src bigint, dst bigint, tag int"), points, metric).collect()
    want = sorted(e for e in edges if max(e[:2]) < 90)
    assert sorted((r["src"], r["dst"], r["tag"]) for r in scored) == want
    for r in scored:
        a, b = vectors[r["src"]].astype(np.float32), vectors[r["dst"]].astype(np.float32)
        a, b = a.astype(float), b.astype(float)
        assert abs(r["d"] - (((a - b) ** 2).sum() if metric == "l2" else -(a * b).sum())) < 1e-5
