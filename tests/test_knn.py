import numpy as np
import pytest

from nearfield.functions import blocks
from nearfield.operators.knn import exact_knn_graph, exact_topk, ground_truth, top_per, topk_join
from nearfield.sources.tables import as_queries
from tests.model import frame, score, topk


def lists(df, key="query_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r["rank"])):
        out.setdefault(r[key], []).append(r["vec_id"] if key == "query_id" else r["dst"])
    return out


def test_fixture_lists(spark, paths):
    base = frame(spark, [[2.0], [0.0], [1.0]])
    assert lists(exact_topk(base, frame(spark, [[0.0]], name="query_id"), 5)) == {0: [1, 2, 0]}
    assert lists(exact_topk(base, frame(spark, [[1.0]], name="query_id"), 3, "ip")) == {0: [0, 2, 1]}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_matches_model_with_duplicates(spark, paths, metric):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(70, 5)).astype("float32")
    vectors[30:55] = vectors[3]  # more than a third share one vector
    points = dict(enumerate(vectors))
    base = frame(spark, vectors)
    got = lists(exact_topk(base, frame(spark, vectors, name="query_id"), 7, metric))
    assert got == topk(points, points, 7, metric)
    graph = lists(exact_knn_graph(base, 2, metric), "src")
    assert graph == topk(points, points, 8, metric, exclude_self=True)


def test_streamed_base(spark):
    rng = np.random.default_rng(2)
    base, queries = rng.normal(size=(90, 4)), rng.normal(size=(3, 4))
    spark.conf.set("spark.nearfield.broadcastBytes", str(3 * 4 * 8))
    try:
        found = exact_topk(frame(spark, base).repartition(3), frame(spark, queries, name="query_id"), 6)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        got = lists(found)
    finally:
        spark.conf.unset("spark.nearfield.broadcastBytes")
    as32 = lambda m: {i: v for i, v in enumerate(m.astype("float32"))}
    assert got == topk(as32(base), as32(queries), 6)


def test_groups_do_not_meet(spark, paths):
    rows = [(g, i, [float(i)]) for g in ("a", "b") for i in range(20 if g == "a" else 3)]
    base = spark.createDataFrame(rows, "grp string, vec_id bigint, v array<float>")
    asked = base.withColumnRenamed("vec_id", "query_id")
    found = topk_join(asked, base, 4, group="grp", exclude_self=True).collect()
    counts = {}
    for r in found:
        counts[(r["grp"], r["query_id"])] = counts.get((r["grp"], r["query_id"]), 0) + 1
    assert all(n == (4 if g == "a" else 2) for (g, _), n in counts.items()) and len(counts) == 23


def test_k_not_positive_and_empty(spark, paths):
    base = frame(spark, [[1.0], [2.0]])
    asked = frame(spark, [[1.0]], name="query_id")
    assert exact_topk(base, asked, 0).collect() == []
    assert exact_topk(base.filter("vec_id < 0"), asked, 3).collect() == []
    assert ground_truth(base, asked.filter("query_id < 0"), 3).collect() == []


def test_dimension_mismatch_raises(spark, paths):
    base = frame(spark, [[1.0, 2.0], [2.0, 3.0]])
    with pytest.raises(Exception, match="dimension"):
        exact_topk(base, frame(spark, [[1.0]], name="query_id"), 1).collect()


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 1e200])
def test_vectors_without_finite_scores_raise(spark, paths, odd):
    base = frame(spark, [[0.0], [odd], [1.0]])
    with pytest.raises(Exception, match="non-finite|finite score"):
        exact_topk(base, as_queries(base), 2).collect()


def test_limits_above_sparks_own_keep_the_first_rows(spark):
    rows = spark.range(3000).selectExpr("0 as g", "id", "cast(2999 - id as double) as d")
    kept = top_per(rows, ["g"], ["d", "id"], 1100).collect()
    assert sorted((r["rank"], r["id"]) for r in kept) == [(i + 1, 2999 - i) for i in range(1100)]


def test_copies_of_a_row_are_bounded(spark):
    """Blocks grow with the table before they are more than ``MOST_CUTS`` a side."""
    from nearfield.runtime import MOST_CUTS, block_count

    spark.conf.set("spark.nearfield.blockRows", "100")
    try:
        assert block_count(spark, 500, 64) == 5
        assert block_count(spark, 100_000, 64) == MOST_CUTS
        assert block_count(spark, 65_536 * 40, 64) == 40
    finally:
        spark.conf.unset("spark.nearfield.blockRows")


def test_growing_tables_are_not_broadcast(spark):
    from nearfield.runtime import sorted_join

    few = spark.range(3).withColumnRenamed("id", "k")
    plan = sorted_join(spark.range(9).withColumnRenamed("id", "k"), few, "k")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def brute(left, left_ids, right, right_ids, k, exclude_self):
    out = []
    for row, own in zip(left, left_ids):
        d = ((row - right) ** 2).sum(axis=1)
        seen = [(d[i], right_ids[i]) for i in range(len(right)) if not (exclude_self and right_ids[i] == own)]
        out += [i for _, i in sorted(seen)[:k]]
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
def test_a_block_is_narrowed_without_sorting_whole_rows(monkeypatch, exclude_self):
    rng = np.random.default_rng(9)
    right, ids = rng.normal(size=(6000, 8)), rng.permutation(6000)
    widths, partition = [], np.partition

    def watched(a, *args, **kwargs):
        widths.append(a.shape[1])
        return partition(a, *args, **kwargs)

    monkeypatch.setattr(np, "partition", watched)
    _, c, _ = blocks.nearest(right[:40], ids[:40], right, ids, 5, "l2", exclude_self)
    assert widths and max(widths) * 8 <= len(right)
    assert ids[c].tolist() == brute(right[:40], ids[:40], right, ids, 5, exclude_self)


def test_neighbours_closer_than_single_precision_are_told_apart():
    rng = np.random.default_rng(10)
    right, ids = 1e4 + 1e-3 * rng.normal(size=(3000, 4)), rng.permutation(3000)
    _, c, _ = blocks.nearest(right[:30], ids[:30], right, ids, 5, "l2")
    assert ids[c].tolist() == brute(right[:30], ids[:30], right, ids, 5, False)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_groups_are_shut_by_parts(metric, monkeypatch):
    """Groups of uneven sizes: parts of one group bound the scores, and give what double precision gives."""
    rng = np.random.default_rng(31)
    right, left = rng.normal(size=(3000, 6)), rng.normal(size=(50, 6))
    group = rng.choice(12, size=3000, p=np.arange(1, 13) / 78) * 5
    ids = rng.permutation(3000) + 7
    open_groups = [np.sort(rng.choice(12, size=7, replace=False)) * 5 for _ in range(50)]
    lists = lambda a, b: (np.arange(b - a + 1) * 7, np.concatenate(open_groups[a:b]))
    used, survivors = [], blocks._part_survivors
    monkeypatch.setattr(blocks, "_part_survivors", lambda *args: used.append(survivors(*args)) or used[-1])
    r, c, d = blocks.nearest_within(left, np.arange(50), right, ids, 4, metric, False, lists, group)
    assert used and used[0] is not None and len(used[0][0]) < 50 * 20
    for q in range(50):
        may = np.flatnonzero(np.isin(group, open_groups[q]))
        best = sorted((score(left[q], right[i], metric), ids[i]) for i in may)[:4]
        assert ids[c[r == q]].tolist() == [i for _, i in best]
        assert np.allclose(d[r == q], [s for s, _ in best])


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_sets_of_nearest_rows_score_only_where_scores_are_close(metric, monkeypatch):
    rng = np.random.default_rng(33)
    right, left = rng.normal(size=(90, 5)), rng.normal(size=(30, 5))
    right[40:60] = right[3]
    ids = rng.permutation(90)
    for k in (1, 12, 25, 90, 200, 0):
        r, c, _ = blocks.nearest(left, np.zeros(30, np.int64), right, ids, k, metric)
        got = blocks.nearest_sets(left, right, ids, k, metric)
        assert sorted(zip(*got)) == sorted(zip(r, c))
    monkeypatch.setattr(blocks, "pair_scores", lambda *args: pytest.fail("scored pair by pair"))
    assert len(blocks.nearest_sets(left, right[:40], ids[:40], 12, metric)[0]) == 360
    with pytest.raises(ValueError, match="too long"):
        blocks.nearest_sets(left * 1e200, right, ids, 3, metric)
