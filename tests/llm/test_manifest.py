"""The Merkle manifest of point tables beside a sequential version."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfield.llm import manifest

SCHEMA = "vec_id bigint, v array<float>, part string, node string, at bigint, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, run):
    """Subroot and the siblings of every node on its way there."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, at in zip(ways, where):
            first = at // run * run
            way.append((nodes[first:at], nodes[at + 1 : first + run]))
        nodes = [sha("".join(nodes[i : i + run])) for i in range(0, len(nodes), run)]
        where = [at // run for at in where]
    return nodes[0], ways


def brute(rows, run):
    """(id, part, leaf) rows with subroot, root and the siblings' digest."""
    parts = {}
    for row in rows:
        parts.setdefault(row[1], []).append(row)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    low = {}
    for part in order:
        parts[part].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        low[part] = climb([r[2] for r in parts[part]], run)
    root, high = climb([low[p][0] for p in order], run)
    for number, part in enumerate(order):
        for row, way in zip(parts[part], low[part][1]):
            steps = way + high[number]
            siblings = sha("".join("".join(a) + "".join(b) for a, b in steps))
            yield (*row, low[part][0], root, siblings)


def make_points(count, parts):
    rows = [(i * 7 % count, [i / 3, float(i)], parts[i * i % len(parts)], "x", i, 1) for i in range(count)]
    rows += [(3, [1.0, 1.0], parts[0], "x", 0, 1), (None, None, parts[-1], "x", 0, 1)] * 2
    return rows + [(5, [9.0], "alone", "x", 0, 1), (9, [9.0], "", "x", 0, 1)]


@pytest.mark.parametrize("run, count, limits", [(8, 700, "broadcast"), (2, 60, "joins"), (3, 1, "joins")])
def test_proofs(spark, run, count, limits):
    if limits == "joins":
        spark.conf.set("spark.nearfield.broadcastBytes", "0")
    try:
        points = spark.createDataFrame(make_points(count, ["b", None, "b", "é", "a/b", "b"]), SCHEMA).repartition(5)
        leaves = points.select("vec_id", "part", manifest.record_digest("vec_id", "v").alias("leaf"), "at")
        rows = manifest.merkle_proofs(leaves, keep=("at",), run=run)
        got = rows.select(
            "vec_id", "part", "leaf", "subroot", "root", manifest.proof_digest().alias("siblings"),
            manifest.fold_proof("leaf").alias("folded"), "at",
        ).collect()
        given = leaves.collect()
        want = Counter(brute([(r.vec_id, r.part, r.leaf) for r in given], run))
        assert Counter(tuple(r)[:6] for r in got) == want
        assert all(r.folded == r.root for r in got)
        assert Counter((r.leaf, r["at"]) for r in got) == Counter((r.leaf, r["at"]) for r in given)
    finally:
        spark.conf.unset("spark.nearfield.broadcastBytes")


def test_record_digest(spark):
    rows = spark.createDataFrame([(12, "é:", None), (None, "", None)], "a bigint, b string, c string")
    found = [r[0] for r in rows.select(manifest.record_digest("a", "b", "c")).collect()]
    assert found == [sha("2:123:é:-"), sha("-0:-")]


def test_tampered_points(spark):
    points = spark.createDataFrame(
        [(i, [float(i), 1.0], "p%d" % (i % 3)) for i in range(90)], "vec_id bigint, v array<float>, part string"
    )
    recorded = manifest.point_manifest(points, "part")
    assert manifest.check_points(recorded, points).filter("verified").count() == 90
    changed = points.filter("vec_id <> 7").withColumn(
        "v", F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(0.5), F.lit(1.0))).otherwise(F.col("v")).cast("array<float>")
    )
    bad = manifest.check_points(recorded, changed).filter("not verified").select("vec_id").collect()
    assert {r[0] for r in bad} == {7, *range(0, 90, 10)}
    # Without parts there is one tree, and another root.
    whole = manifest.point_manifest(points)
    assert whole.filter("subroot <> root").isEmpty()
    assert whole.first().root != recorded.first().root


def test_manifest_of_nothing_and_long_fields(spark):
    points = spark.createDataFrame([], SCHEMA)
    assert manifest.point_manifest(points, "part").count() == 0
    long = spark.createDataFrame([(1, "x" * 300_000)], "vec_id bigint, v string")
    row = manifest.point_manifest(long).first()
    assert row.leaf == row.subroot == row.root == sha("1:1300000:" + "x" * 300_000)
    with pytest.raises(ValueError):
        manifest.merkle_proofs(points.withColumn("leaf", F.lit("")), run=1)
