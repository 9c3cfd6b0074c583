import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators.prune import project
from nearfield.sources.tables import read_points, synthetic_points
from tests.model import close, frame


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_distances(spark):
    a, b = vec(1, 2, 3), vec(4, 6, 8)
    assert one(spark, V.l2_squared(a, b)) == 50
    assert one(spark, V.dot(a, b)) == 40
    assert one(spark, V.metric_score(a, b, "ip")) == -40
    assert close(one(spark, V.l2_from_norms(a, b)), 50)
    with pytest.raises(ValueError):
        V.metric_score(a, b, "cosine")


def test_clamp(spark):
    for d, expected in [(-5e-5, 0.0), (-1e-4, -1e-4), (-1.0, -1.0), (0.5, 0.5)]:
        assert one(spark, V.clamp_distance(F.lit(d))) == expected


def test_qps(spark):
    cases = [(0, 0.25, 0.0), (5, 2.0, 2.5), (5, 0.0, 5e6)]
    for count, seconds, expected in cases:
        assert close(one(spark, V.qps(F.lit(count), F.lit(seconds))), expected)


def test_dimension_guard_is_not_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id bigint, embedding array<float>")
    rows.write.parquet(str(tmp_path / "t"))
    points = read_points(spark, str(tmp_path / "t"), dim=2)
    with pytest.raises(Exception, match="dimension mismatch"):
        points.select("v").collect()


def test_residual_hash(spark):
    points = frame(spark, [[0.0], [1.0], [-1.0]])
    planes = [[1.0], [-1.0]]
    p = {r["vec_id"]: r["p"] for r in project(points, planes).collect()}
    code = lambda a, b: one(spark, V.residual_hash(vec(*p[a]), vec(*p[b]), planes))
    assert code(0, 1) == 1
    assert code(0, 2) == 2
    assert code(0, 0) == 3


def test_hyperplanes_match_the_column_draw(spark):
    planes = V.hyperplanes(3, 4, 7)
    for bit in range(3):
        for axis in range(4):
            assert close(one(spark, V.gaussian(F.lit(f"7:{bit}:{axis}"))), planes[bit][axis])
    assert V.hyperplanes(0, 4, 7) == []


def test_valid_edges(spark):
    points = frame(spark, [[0.0], [1.0], [2.0]])
    edges = spark.createDataFrame([(0, 1), (0, 0), (1, -1), (1, 3), (2, 0)], "src bigint, dst bigint")
    got = {tuple(r) for r in V.valid_edges(edges, points).collect()}
    assert got == {(0, 1), (2, 0)}


def test_synthetic_points_do_not_depend_on_partitions(spark):
    made = synthetic_points(spark, 60, 8, 42)
    first = {r["vec_id"]: r["v"] for r in made.collect()}
    again = {r["vec_id"]: r["v"] for r in made.repartition(7).collect()}
    assert first == again and len(first) == 60
    values = [x for v in first.values() for x in v]
    assert abs(sum(values) / len(values)) < 0.15
    assert abs(sum(x * x for x in values) / len(values) - 1) < 0.25


def test_copies_beyond_the_nearest_are_left_out():
    import numpy as np

    from nearfield.functions import blocks

    values = np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0], [2.0, 0.0]])
    ids = np.array([5, 4, 3, 3, 1, 0, 9, 8])
    kept = blocks.first_copies(values, (values * values).sum(axis=1), ids, 2)
    assert sorted(ids[kept]) == [0, 1, 8, 9]
    # A repeated id is never its own neighbour, and costs no other.
    r, c, d = blocks.nearest(values, ids, values, ids, 2, "l2", exclude_self=True)
    assert [int(ids[x]) for x in c[r == 2]] == [0, 1]
    assert [int(ids[x]) for x in c[r == 5]] == [1, 3]
