"""Near-duplicate points and components beside brute force, and the registered llm queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, normal, oracle_rows
from nearfield.llm.components import connected_components
from nearfield.llm.oracle import ORACLE
from nearfield.llm.queries import QUERIES
from nearfield.llm.vectordups import RangeGraphParams, near_duplicate_points

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_components(spark, paths):
    links = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50), (None, 3), (60, 61), (61, 59)]
    rows = connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()
    want = {i: 0 for i in range(31)} | {40: 40, 41: 40, 59: 59, 60: 59, 61: 59}
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


@pytest.mark.parametrize("shard_rows", [1200, 60])
def test_near_duplicate_points(spark, shard_rows):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    v[100:160] = v[7] + 0.05 * rng.normal(size=(60, 8))  # a dense group
    v[200:220] = v[3]  # copies
    v[220] = 4 * v[3]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    odd = [(300, None, "x"), (301, [0.0] * 8, "x"), (302, [float("nan")] + [1.0] * 7, "x"),
           (303, [1.0, 2.0], "x"), (304, [None] + [1.0] * 7, "x"), (None, v[3].tolist(), "x"), (305, [], "x")]
    points = spark.createDataFrame(rows + odd, "vec_id bigint, v array<double>, kept string").repartition(3)
    got = near_duplicate_points(points, RangeGraphParams(shard_rows=shard_rows)).collect()
    assert len(got) == len(rows) + len(odd)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.minimum(label, np.where(close, label[None, :], len(v)).min(axis=1))
        if (new == label).all():
            break
        label = new
    found = {r.vec_id: r for r in got}
    missed = sum(close.sum(axis=1)[i] - found[i].n_links for i in range(300))
    assert 0 <= missed <= 0.03 * close.sum()
    assert all(found[i].n_links <= close.sum(axis=1)[i] for i in range(300))
    assert np.mean([found[i].component_id == label[i] for i in range(300)]) >= 0.99
    for i in range(300, 306):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert near_duplicate_points(points.limit(0)).count() == 0


def test_sparse_links_after_several_splits(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 32))
    v[1440:] = v[:60] + 0.3 * rng.normal(size=(60, 32))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, v array<double>")
    params = RangeGraphParams(shard_rows=100, max_leaders=16, max_fanout=2)
    found = {r.vec_id: r.n_links for r in near_duplicate_points(points, params).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    close = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert close.sum() >= 60
    assert all(found[i] <= close[i] for i in range(1500))
    assert sum(found.values()) >= 0.97 * close.sum()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(*oracle_rows(connect(SF), ORACLE[name]))


@needs_data
def test_pipeline(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == given.columns
    assert docs.join(given.select("doc_id"), "doc_id", "left_anti").count() == 0
    result = corpus_pipeline.run(spark, SF)
    assert result.filter("length < 1 or length > 2048").count() == 0
    per = result.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert per.filter("n % doc_tokens <> 0").count() == 0
