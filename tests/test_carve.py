import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import carve as R
from nearfield.params import CarveParams
from tests.model import carve_tree, frame, partition


def leaves_by_number(built, replica=0):
    out = {}
    for r in built.leaves.filter(F.col("replica") == replica).collect():
        out.setdefault(r["leaf_id"], []).append(r["vec_id"])
    assert sorted(out) == list(range(len(out)))
    return [sorted(out[n]) for n in sorted(out)]


def check(spark, vectors, params, replicas=1):
    vectors = np.asarray(vectors, dtype="float32")
    built = R.build_partition(frame(spark, vectors), params, replicas)
    points = dict(enumerate(vectors))
    for replica in range(replicas):
        assert leaves_by_number(built, replica) == partition(points, params, replica)
    return {r["replica"]: r for r in R.partition_stats(built).collect()}


def test_leader_count(spark):
    params = CarveParams(leader_frac=0.02, max_leaders=1000)
    rows = spark.createDataFrame([(n,) for n in (1, 2, 50, 150, 500, 10**6)], "n bigint")
    got = [r[0] for r in rows.select(R.leader_count("n", params)).collect()]
    assert got == [1, 2, 2, 3, 10, 1000]


def test_leader_ties_go_to_the_smaller_id(spark, paths):
    members = spark.createDataFrame([("g", 0, [1.0, 0.0])], "path string, vec_id bigint, v array<float>")
    leaders = spark.createDataFrame(
        [("g", 2, [2.0, 0.0], 0), ("g", 1, [0.0, 0.0], 1)],
        "path string, vec_id bigint, v array<float>, child bigint",
    )
    row = R.assign_to_leaders(members, leaders).first()
    assert (row["leader"], row["child"]) == (1, 1)


def test_recursive_partition_matches_model(spark, paths):
    rng = np.random.default_rng(3)
    params = CarveParams(cmax=16, fanout=3, leader_frac=0.06, seed=11)
    stats = check(spark, rng.normal(size=(110, 4)), params, 2)
    assert stats[0]["max_membership"] <= 3 and stats[0]["leaf_count"] > 8


def test_inner_product_partition_matches_model(spark):
    rng = np.random.default_rng(4)
    params = CarveParams(cmax=16, fanout=2, leader_frac=0.1, seed=5, metric="ip")
    check(spark, rng.normal(size=(120, 3)) + 0.5, params)


def test_a_third_of_the_points_are_equal(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 3))
    vectors[20:50] = 1.5
    stats = check(spark, vectors, CarveParams(cmax=10, fanout=2, leader_frac=0.2, seed=2))
    assert stats[0]["fallback_chunk_splits"] > 0


def test_identical_points_are_cut_into_runs(spark):
    params = CarveParams(cmax=4, fanout=2, max_leaders=2)
    stats = check(spark, np.ones((20, 2)), params)[0]
    assert stats["fallback_chunk_splits"] == 5 and 20 < stats["assignment_total"] <= 40
    built = R.build_partition(frame(spark, np.ones((8, 2))), params)
    assert [len(leaf) for leaf in leaves_by_number(built)] == [8, 8]


def test_line_without_overlap(spark):
    params = CarveParams(cmax=3, fanout=1, leader_frac=0.25)
    stats = check(spark, [[float(i), 0.0] for i in range(10)], params)[0]
    assert stats["max_membership"] == 1 and stats["max_leaf_size"] <= 3


def test_small_and_empty_inputs(spark):
    built = R.build_partition(frame(spark, [[0.0]] * 8), CarveParams(cmax=8))
    assert leaves_by_number(built) == [list(range(8))]
    empty = R.build_partition(frame(spark, [[0.0]]).filter("vec_id > 5"), CarveParams(cmax=8))
    assert empty.leaves.count() == 0 and R.point_memberships(empty.leaves).count() == 0


def test_invariants_and_repeatability(spark):
    vectors = [[float(i), 0.0, 0.0, 0.0] for i in range(200)]
    params = CarveParams(cmax=32, fanout=2, leader_frac=0.1)
    first = R.build_partition(frame(spark, vectors), params)
    second = R.build_partition(frame(spark, vectors).repartition(5), params)
    rows = lambda b: sorted(tuple(r) for r in b.leaves.collect())
    assert rows(first) == rows(second)
    stats = R.partition_stats(first).first()
    assert {r[2] for r in rows(first)} == set(range(200))
    assert stats["max_membership"] <= 2 and 200 < stats["assignment_total"] <= 400


def test_sampling_falls_back_when_the_hash_cut_is_short(spark, monkeypatch):
    rows = frame(spark, [[float(i)] for i in range(300)])
    members = rows.select(R.digits(F.lit(0)).alias("path"), "vec_id")
    groups = spark.createDataFrame([("0" * 8, 300)], "path string, n bigint")
    params = CarveParams(leader_frac=0.1)
    exact = {tuple(r) for r in R.sample_leaders(members, groups, params, False).collect()}
    quick = {tuple(r) for r in R.sample_leaders(members, groups, params, True).collect()}
    assert quick == exact and len(exact) == 30
    original = R.sample_leaders

    def short(members, groups, params, prefilter=True):
        chosen = original(members, groups, params, prefilter)
        return chosen.filter("child < 3") if prefilter else chosen

    monkeypatch.setattr(R, "sample_leaders", short)
    assert R.leaders_of_level(members, rows, groups, params)[0].count() == 30


@pytest.mark.parametrize("bad", [{"cmax": 0}, {"max_leaders": 0}, {"metric": "cosine"}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        CarveParams(**bad)


def test_fanout_is_clamped_to_the_children_of_the_root(spark):
    points = frame(spark, [[0.0]] * 20 + [[10.0]] * 4)
    part = R.build_partition(points, CarveParams(cmax=4, fanout=3, seed=3), 1)
    row = R.partition_stats(part).first()
    assert (row["max_membership"], row["assignment_total"]) == (2, 48)


@pytest.mark.parametrize("limits", [{}, {"blockRows": "40", "sliceRows": "200"}])
def test_levels_of_a_crowded_group_take_no_jobs_of_their_own(spark, monkeypatch, limits):
    """Half of the points are equal; as copies of one vector they fit a task even where blocks are small."""
    rng = np.random.default_rng(41)
    vectors = rng.normal(size=(160, 3))
    vectors[30:110] = 0.3
    vectors[110:125] = 0.3 + 0.01 * rng.normal(size=(15, 3))
    levels, steps, route = [], [], R.nearest_children
    draw = R.leaders_of_level
    monkeypatch.setattr(R, "leaders_of_level", lambda *args: levels.append(1) or draw(*args))
    monkeypatch.setattr(R, "nearest_children", lambda *args: steps.append(1) or route(*args))
    params = CarveParams(cmax=12, fanout=3, leader_frac=0.03, seed=5)
    for name, value in limits.items():
        spark.conf.set(f"spark.nearfield.{name}", value)
    try:
        stats = check(spark, vectors, params, 2)
    finally:
        for name in limits:
            spark.conf.unset(f"spark.nearfield.{name}")
    assert all(s["fallback_chunk_splits"] > 0 for s in stats.values())
    depth = lambda node: 1 + max((depth(c) for c in node["children"]), default=0)
    tree = carve_tree(dict(enumerate(np.asarray(vectors, dtype="float32"))), params)
    assert depth(tree) > 5
    # A level, and one more where a root is too large for a task; the children of the root are found once.
    assert len(levels) <= (2 if limits else 1) and len(steps) == 1
