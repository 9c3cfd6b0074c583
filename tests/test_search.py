import numpy as np
import pytest

from nearfield.operators import search
from nearfield.operators.cells import approx_baseline
from nearfield.operators.evaluate import recall_at_k, recall_micro
from nearfield.operators.search import beam_search, search_refined_graph
from nearfield.params import BuildParams, CarveParams, PruneParams, SearchParams
from nearfield.plans.build import build_graph, build_graph_hashprune, build_profile, run_benchmark
from tests.model import best_first, close, frame


def graph_table(spark, nbrs):
    rows = [(i, j, n + 1) for i, near in nbrs.items() for n, j in enumerate(near)]
    return spark.createDataFrame(rows, "src bigint, dst bigint, rank int")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def table(spark, rows):
    flat = [(q, n + 1, i) for q, ids in rows.items() for n, i in enumerate(ids)]
    return spark.createDataFrame(flat, "query_id bigint, rank int, vec_id bigint")


@pytest.fixture
def branch(spark):
    """A bad branch that looks near at first; node 50 holds the answer."""
    position = {0: 10.0, 40: 9.45, 50: 0.01}
    vectors = [[position.get(i, 9.0 + i * 0.1)] for i in range(60)]
    nbrs = {0: [1, 40], **{i: [i + 1] for i in range(1, 30)}, 40: [50], 50: [40, 40]}
    return frame(spark, vectors), graph_table(spark, nbrs), dict(enumerate(vectors)), nbrs


def test_bad_branch_cycle_and_no_beam(spark, paths, branch):
    points, edges, model, nbrs = branch
    query = frame(spark, [[0.0]], name="query_id")
    got = lists(beam_search(edges, points, query, SearchParams(beam=15, topk=5, prefetch=3)))
    assert got[0] == best_first(model, nbrs, [0.0], 15, 5) and got[0][0] == 50
    assert len(lists(search_refined_graph(edges, points, query, SearchParams(beam=3)))[0]) <= 3
    assert lists(beam_search(edges, points, query, SearchParams(beam=0))) == {}


@pytest.mark.parametrize("prefetch", [1, 5])
def test_random_graphs_match_sequential_search(spark, paths, prefetch):
    rng = np.random.default_rng(12)
    n = 60
    vectors = np.round(rng.normal(size=(n, 2)), 1).astype("float32")
    vectors[10:25] = vectors[4]
    nbrs = {i: rng.choice(n, size=4, replace=False).tolist() for i in range(n) if i % 7}
    queries = np.round(rng.normal(size=(6, 2)), 1).astype("float32")
    beam = 12 if prefetch == 5 else 6
    for metric in ("l2", "ip") if prefetch == 5 else ("l2",):
        params = SearchParams(beam=beam, topk=8, entry=3, metric=metric, prefetch=prefetch)
        got = lists(
            beam_search(graph_table(spark, nbrs), frame(spark, vectors),
                        frame(spark, queries, name="query_id"), params)
        )
        for q in range(6):
            assert got[q] == best_first(vectors, nbrs, queries[q], beam, 8, 3, metric)


def test_entry_must_exist(spark):
    points = frame(spark, [[0.0]])
    edges = graph_table(spark, {0: [0]})
    with pytest.raises(ValueError, match="entry"):
        beam_search(edges, points, frame(spark, [[0.0]], name="query_id"), SearchParams(entry=9))


def test_recall(spark):
    recall = lambda t, f, k: recall_at_k(table(spark, t), table(spark, f), k).first()["recall"]
    assert close(recall({0: [1, 2, 3], 1: [4, 5, 6]}, {0: [1, 4, 2], 1: [6, 9, 4]}, 3), 2 / 3)
    assert close(recall({0: [7]}, {0: [7]}, 10), 0.1)
    assert close(recall({0: [1], 1: [2]}, {0: [1]}, 1), 0.5)
    empty = table(spark, {0: [1]}).filter("rank > 5")
    assert recall_at_k(empty, table(spark, {0: [1]}), 3).first()["recall"] == 0
    assert recall_at_k(table(spark, {0: [1]}), empty, 3).first()["recall"] == 0


def test_recall_micro(spark):
    truth, found = table(spark, {0: [0, 2], 1: [1, 3]}), table(spark, {0: [2, 0], 1: [3, 1]})
    assert recall_micro(truth, found, 2).first()["recall"] == 1.0
    wide = table(spark, {0: [5, 6, 7]})
    assert recall_micro(wide, table(spark, {0: [7]}), 1).first()["recall"] == 1.0
    assert recall_micro(wide.filter("rank > 9"), found, 2).first()["recall"] == 0.0


@pytest.fixture(scope="module")
def cloud(spark):
    return frame(spark, [[float(i), float(i % 7)] + [0.0] * 6 for i in range(300)])


def test_build_graph_and_profile(spark, cloud):
    params = BuildParams(CarveParams(cmax=64), PruneParams(max_degree=16), replicas=0, leaf_k=8)
    profile = build_profile(cloud, params)
    row = profile.row().first()
    assert row["prune_kept"] >= row["prune_final_edges"] == profile.edges.count()
    assert row["prune_kept"] - row["prune_replaced"] - row["prune_evicted"] == row["prune_final_edges"]
    assert profile.edges.groupBy("src").count().agg({"count": "max"}).first()[0] <= 16
    assert min(row[s] for s in ("partition_sec", "leaf_knn_sec", "prune_sec")) > 0
    assert len(profile.row().columns) == 16


def test_benchmark_without_queries(spark, cloud):
    params = BuildParams(CarveParams(cmax=64), PruneParams(max_degree=8), leaf_k=4)
    none = frame(spark, [[0.0] * 8], name="query_id").filter("query_id > 0")
    row = run_benchmark(cloud, none, "refined", params, SearchParams(beam=8)).first()
    assert row["qps"] == 0 and row["recall_at_10"] == 0 and row["edges"] > 0


def test_exact_graph_finds_everything(spark, cloud):
    params = BuildParams(prune=PruneParams(max_degree=8))
    queries = cloud.withColumnRenamed("vec_id", "query_id")
    row = run_benchmark(cloud, queries, "exact", params, SearchParams(beam=320)).first()
    assert row["mode"] == "exact" and row["recall_at_10"] == 1.0 and row["edges"] == 2400


def test_modes_are_checked(spark, cloud):
    with pytest.raises(ValueError, match="mode"):
        build_graph(cloud, "hnsw", BuildParams())
    with pytest.raises(ValueError, match="l2"):
        build_graph_hashprune(cloud, BuildParams().with_metric("ip"))


def test_cells_with_all_probes_are_exact(spark, cloud):
    from nearfield.operators.knn import ground_truth

    queries = cloud.withColumnRenamed("vec_id", "query_id")
    every = approx_baseline(cloud, queries, 5, cells=8, probes=8)
    truth = ground_truth(cloud, queries, 5)
    assert recall_at_k(truth, every, 5).first()["recall"] == 1.0
    few = approx_baseline(cloud, queries, 5, cells=8, probes=1)
    assert 0 < recall_at_k(truth, few, 5).first()["recall"] <= 1.0


def test_cells_reach_the_recall_by_default(spark):
    from nearfield.operators.knn import ground_truth

    v = np.random.default_rng(6).normal(size=(250, 32))
    points = frame(spark, v.tolist())
    queries = points.withColumnRenamed("vec_id", "query_id")
    found = approx_baseline(points, queries, 5)
    assert recall_at_k(ground_truth(points, queries, 5), found, 5).first()["recall"] >= 0.9


@pytest.mark.parametrize("probes", [1, 5])
def test_a_query_meets_a_block_of_codes_once(spark, paths, monkeypatch, probes):
    from nearfield.operators import cells as cells_module

    v = np.random.default_rng(7).integers(-20, 20, size=(240, 3)).astype(float)
    points = frame(spark, v.tolist())
    queries = points.withColumnRenamed("vec_id", "query_id")
    index = cells_module.build_cell_index(points, queries, 4, cells=10, probes=probes)
    counts, join = [], cells_module.topk_join

    def counted(asked, *args, **kwargs):
        counts.append(asked.count())
        return join(asked, *args, **kwargs)

    monkeypatch.setattr(cells_module, "topk_join", counted)
    found = cells_module.probe_cells(index, queries, 4)
    assert max(counts) == 240

    cell = {r["vec_id"]: r["cell"] for r in index.members.select("vec_id", "cell").collect()}
    centres = [(r["vec_id"], np.array(r["v"])) for r in index.centres.collect()]
    far = lambda a, b: float(((a - b) ** 2).sum())
    for query, hits in lists(found).items():
        near = {i for _, i in sorted((far(v[query], c), i) for i, c in centres)[:probes]}
        assert {cell[i] for i in hits} <= near
        # The codes of such small components rank as the vectors do, up to their rounding.
        best = sorted((far(v[query], v[i]), i) for i in range(240) if cell[i] in near)[:4]
        assert [round(far(v[query], v[i])) for i in hits] == [round(d) for d, _ in best]


def test_an_edge_listed_twice_is_followed_once(spark, paths):
    points = frame(spark, [[3.0], [2.0], [1.0], [0.0]])
    graph = graph_table(spark, {0: [1, 1], 1: [2, 2], 2: [3]})
    asked = spark.createDataFrame([(7, [1.0])], "query_id bigint, v array<double>")
    found = beam_search(graph, points, asked, SearchParams(beam=3, topk=10))
    assert lists(found)[7] == [2, 1, 0]


def test_a_graph_is_counted_as_it_is_sent(spark, monkeypatch):
    """Components and positions of four bytes, every neighbour once: less than half of what was counted before."""
    rng = np.random.default_rng(21)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    nbrs = {i: rng.choice(60, size=4, replace=False).tolist() for i in range(60) if i % 9}
    edges = graph_table(spark, nbrs).unionByName(graph_table(spark, {1: [99], 98: [3]}))
    points = frame(spark, vectors).selectExpr("vec_id", "CAST(v AS array<float>) AS v")
    queries = frame(spark, vectors[:5] + np.float32(0.1), name="query_id")
    params = SearchParams(beam=12, topk=8, entry=3)
    assert 60 * 8 * 8 + 20 * 2 * edges.count() > 2 * 2000
    monkeypatch.setattr(search, "_round", lambda *args: pytest.fail("searched in rounds"))
    spark.conf.set("spark.nearfield.broadcastBytes", "2000")
    try:
        got = lists(beam_search(edges.unionByName(edges), points, queries, params))
    finally:
        spark.conf.unset("spark.nearfield.broadcastBytes")
    for q in range(5):
        assert got[q] == best_first(vectors, nbrs, vectors[q] + np.float32(0.1), 12, 8, 3, "l2")


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_a_graph_beyond_the_broadcast_is_shuffled_to_parts_of_the_queries(spark, monkeypatch, metric):
    """Two graphs, nodes and neighbours without a vector, ids out of order, and more queries than a step takes."""
    rng = np.random.default_rng(22)
    vectors = np.round(rng.normal(size=(70, 3)), 1).astype("float32")
    vectors[20:40] = vectors[4]
    ids = [int(i) * 3 - 50 for i in rng.permutation(70)]
    model = dict(zip(ids, vectors))
    graphs = [
        {i: rng.choice(ids, size=size, replace=False).tolist() for i in ids if i % 7} for size in (3, 6)
    ]
    wrong = {1000: [ids[0]], ids[1]: [*graphs[0].get(ids[1], []), 1001]}
    edges = None
    for number, nbrs in enumerate(graphs):
        table = graph_table(spark, {**nbrs, **wrong} if number == 0 else nbrs).selectExpr(f"{number} AS graph_id", "src", "dst")
        edges = table if edges is None else edges.unionByName(table).unionByName(table)
    queries = np.round(rng.normal(size=(9, 3)), 1)
    asked = [(g, q, [12, 5][g], queries[q].tolist()) for g in (0, 1) for q in range(9)] + [(7, 3, 4, [0.0] * 3)]
    asked = spark.createDataFrame(asked, "graph_id int, query_id bigint, beam int, v array<double>")
    points = frame(spark, vectors, ids)
    points = points.unionByName(points.limit(1).selectExpr("CAST(NULL AS bigint) AS vec_id", "v"))
    monkeypatch.setattr(search, "_round", lambda *args: pytest.fail("searched in rounds"))
    monkeypatch.setattr(search, "_search_broadcast", lambda *args: pytest.fail("sent through the driver"))
    monkeypatch.setattr(search, "_TOGETHER", 4)
    spark.conf.set("spark.nearfield.broadcastBytes", "300")
    try:
        found = search.search_graphs(edges, points, asked, SearchParams(topk=8, entry=ids[2], metric=metric)).collect()
    finally:
        spark.conf.unset("spark.nearfield.broadcastBytes")
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r["graph_id"], r["query_id"]), []).append(r["vec_id"])
    for g, nbrs in enumerate(graphs):
        for q in range(9):
            assert got.pop((g, q)) == best_first(model, nbrs, queries[q], [12, 5][g], 8, ids[2], metric)
    assert got == {(7, 3): [ids[2]]}


def counting(spark, df):
    """The same rows, and a counter of those that were made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_micro_recall_reads_truth_once(spark):
    truth, made = counting(spark, table(spark, {q: [q, q + 1, q + 2] for q in range(40)}))
    found = table(spark, {q: [q + 2, 99] for q in range(20)})
    assert recall_micro(truth, found, 2).first()["recall"] == 0.5
    assert made.value == 120


def test_probing_compares_the_codes_once(spark, paths, monkeypatch):
    from nearfield.operators import cells as cells_module

    points = frame(spark, np.random.default_rng(8).normal(size=(150, 4)).tolist())
    queries = points.withColumnRenamed("vec_id", "query_id")
    index = cells_module.build_cell_index(points, queries, 3, cells=6, probes=4)
    join, counters = cells_module.topk_join, []

    def counted(*args, **kwargs):
        found, made = counting(spark, join(*args, **kwargs))
        counters.append(made)
        return found

    monkeypatch.setattr(cells_module, "topk_join", counted)
    assert cells_module.probe_cells(index, queries, 3).count() == 450
    assert len(counters) == 1 and counters[0].value == 150 * max(3, index.shortlist)
