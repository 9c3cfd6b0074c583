"""Randomized ball carving: split the points into leaves, all groups of a level at once.

A node of the partition is named by ``path``: eight hex digits for the replica,
then eight for the child number on every level. A node's children share its
path as a prefix and leaves sort by path in depth-first order. All replicas
are carved by the same jobs, and so are replicas with settings of their own
(``CarveRoots``), each a root of one forest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearfield.functions import blocks
from nearfield.operators.knn import footprint, top_per, topk_join
from nearfield.params import CarveParams, CarveRoots
from nearfield.runtime import (
    BROADCAST_BYTES, SLICE_ROWS, block_rows, materialize, positions, setting, sorted_join, write_table,
)

DIGITS = 8
NODE_SCHEMA = "path string, parent string, representative bigint, is_leaf boolean, chunked boolean"
LEAF_SCHEMA = "path string, vec_id bigint"
ROW_SCHEMA = "path string, vec_id bigint, parent string, fate string"
BUCKET_SCHEMA = (
    "parent string, child bigint, n bigint, representative bigint, parent_n bigint, "
    "fate string, path string"
)
RUN_SCHEMA = "path string, parent string, vec_id bigint"
#: Leaf rows (``is_leaf`` null) and nodes, whose ``vec_id`` is the representative.
CARVED_SCHEMA = "path string, parent string, vec_id bigint, is_leaf boolean, chunked boolean"
#: Rows that are routed together in a task.
_ROUTED_ROWS = 50_000


def digits(number) -> Column:
    """A child number as fixed-width hex, so that text order is number order."""
    number = F.col(number) if isinstance(number, str) else number
    return F.lpad(F.lower(F.hex(number)), DIGITS, "0")


def replica_of(path="path") -> Column:
    return F.conv(F.substring(path, 1, DIGITS), 16, 10).cast("int")


def setting_of(params: CarveParams | CarveRoots, name: str, path="path") -> Column:
    """A setting of the root that ``path`` belongs to."""
    if isinstance(params, CarveParams):
        value = F.lit(getattr(params, name))
        return value + replica_of(path) if name == "seed" else value
    values = params.values(name)
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.get(F.array(*map(F.lit, values)), replica_of(path))


def leader_count(n, params: CarveParams | CarveRoots) -> Column:
    """How many leaders a group of ``n`` points gets; the product is in FLOAT.

    With ``CarveRoots`` a column ``path`` tells whose settings hold.
    """
    n = F.col(n) if isinstance(n, str) else n
    share = (n.cast("float") * setting_of(params, "leader_frac").cast("float")).cast("bigint")
    return F.least(
        F.greatest(F.lit(2).cast("bigint"), share),
        setting_of(params, "max_leaders").cast("bigint"),
        n.cast("bigint"),
    )


def sampling_hash(params: CarveParams | CarveRoots) -> Column:
    """The pseudo-random order in which the points of a group become leaders."""
    seed = setting_of(params, "seed").cast("string")
    inner = F.expr(f"substring(path, {DIGITS + 1})")
    label = F.when(inner == "", F.lit("")).otherwise(F.concat(inner, F.lit(":")))
    return F.md5(F.concat(seed, F.lit(":"), label, F.col("vec_id").cast("string")))


def sample_leaders(
    members: DataFrame, groups: DataFrame, params: CarveParams, prefilter: bool = True
) -> DataFrame:
    """The first ``leader_count`` members of each group in hash order, numbered from 0.

    ``members`` has ``path, vec_id`` and ``groups`` has ``path, n``. Rows whose
    hash is far above the expected cut are dropped before the sort, so a huge
    group sends about four times its leader count to the shuffle. The cut is
    exact as long as enough rows pass it; ``leaders_of_level`` checks that and
    falls back to ``prefilter=False``.
    """
    wanted = leader_count("n", params)
    rows = members.join(groups.select("path", "n"), "path").withColumn("_h", sampling_hash(params))
    if prefilter:
        share = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
        rows = rows.filter(share < (4 * wanted + 100) / F.col("n"))
    most = params.max_leaders if isinstance(params, CarveParams) else max(params.values("max_leaders"))
    return (
        top_per(rows, ["path"], ["_h", "vec_id"], most)
        .filter(F.col("rank") <= wanted)
        .withColumn("child", (F.col("rank") - 1).cast("bigint"))
        .drop("rank", "_h", "n")
    )


def leaders_of_level(members, points, groups, params: CarveParams) -> tuple[DataFrame, int]:
    """Materialized leaders ``path, vec_id, child, v`` of all groups, and their bytes."""
    expected = groups.agg(F.sum(leader_count("n", params))).first()[0]
    for prefilter in (True, False):
        chosen = sample_leaders(members, groups, params, prefilter)
        leaders = materialize(sorted_join(chosen, points, "vec_id"), "leaders")
        count, size = footprint(leaders)
        if count == expected:
            return leaders, size
    raise RuntimeError(f"{count} leaders were drawn where {expected} are wanted; are ids unique?")


def assign_to_leaders(
    members: DataFrame, leaders: DataFrame, metric: str = "l2", leader_bytes: int | None = None
) -> DataFrame:
    """The nearest leader of every member in its group, ties to the smaller leader id.

    ``members`` has ``path, vec_id, v``; ``leaders`` has ``path, vec_id, v, child``.
    """
    queries = members.select("path", F.col("vec_id").alias("query_id"), "v")
    found = topk_join(
        queries, leaders, 1, metric, group="path", carry="child", base_bytes=leader_bytes
    )
    return found.select(
        F.col("path").alias("parent"),
        F.col("query_id").alias("vec_id"),
        F.col("vec_id").alias("leader"),
        "child",
        "d",
    )


def bucket_sizes(assigned: DataFrame, groups: DataFrame, params: CarveParams) -> DataFrame:
    """Non-empty buckets with their fate: ``leaf``, ``split`` again, or ``chunk``."""
    parents = groups.select(F.col("path").alias("parent"), F.col("n").alias("parent_n"))
    return (
        assigned.groupBy("parent", "child")
        .agg(F.count(F.lit(1)).alias("n"), F.min("leader").alias("representative"))
        .join(parents, "parent")
        .withColumn(
            "fate",
            F.when(F.col("n") == F.col("parent_n"), "chunk")
            .when(F.col("n") <= setting_of(params, "cmax", "parent"), "leaf")
            .otherwise("split"),
        )
        .withColumn("path", F.concat("parent", digits("child")))
    )


def chunk_split(members: DataFrame, cmax: int | Column) -> DataFrame:
    """Cut groups into consecutive runs of ``cmax`` ids; each run is a child leaf."""
    numbered = positions(members.select("parent", "vec_id"), ["parent"], ["vec_id"])
    chunk = F.floor((F.col("pos") - 1) / cmax).cast("bigint")
    return numbered.select(F.concat("parent", digits(chunk)).alias("path"), "parent", "vec_id")


@dataclass
class Forest:
    """Home leaves ``path, vec_id`` and the tree nodes of all replicas.

    Both read materialized tables of the levels, so they are cheap to reuse.
    """

    leaves: DataFrame
    nodes: DataFrame
    depth: int
    replicas: int


def carve(points: DataFrame, params: CarveParams | CarveRoots, replicas: int = 1) -> Forest:
    """Carve ``points`` into leaves of at most ``cmax`` points.

    One round of jobs per level, for all oversized groups of all roots that no
    task can hold; below them, a task carves a group to the end (``_within_tasks``), as
    where many points are equal, levels may only split off a few points each.
    Only group counts come to the driver. Ids travel between the levels; the
    vectors are joined to them where they are compared. ``CarveRoots`` has the
    replicas in it and is carved whole.
    """
    spark = points.sparkSession
    params = CarveRoots.of(params, replicas)
    replicas = len(params.roots)
    total = points.count()
    ids = points.select("vec_id")
    if total == 0:
        return Forest(
            spark.createDataFrame([], LEAF_SCHEMA), spark.createDataFrame([], NODE_SCHEMA), 0, replicas
        )
    small = [r for r, cmax in enumerate(params.values("cmax")) if total <= cmax]
    large = [r for r in range(replicas) if r not in small]
    whole = ids.withColumn("path", F.explode(_root_paths(small))).select("path", "vec_id")
    first = ids.agg(F.min("vec_id").alias("representative"))
    single = first.select(
        F.explode(_root_paths(small)).alias("path"), F.lit("").alias("parent"), "representative",
        F.lit(True).alias("is_leaf"), F.lit(False).alias("chunked"),
    )
    if not large:
        return Forest(whole, single, 0, replicas)

    read = lambda schema, paths: spark.read.schema(schema).parquet(*paths)
    groups = spark.range(1).select(F.explode(_root_paths(large)).alias("path"), F.lit(total).cast("bigint").alias("n"))
    members = ids.withColumn("path", F.explode(_root_paths(large))).select("path", "vec_id")
    with_vectors = points.withColumn("path", F.explode(_root_paths(large)))
    # One table per level and kind, read together at the end: the plan stays
    # the same size however deep the recursion goes.
    rows, buckets, runs, carved, depth = [], [], [], [], 0
    dim, unique = points.agg(F.max(F.size("v"))).first()[0] or 0, _ids_differ(points)
    while True:
        depth += 1
        leaders, size = leaders_of_level(members, points, groups, params)
        nearest = assign_to_leaders(with_vectors, leaders, params.metric, size)
        assigned = materialize(nearest.drop("d"), "assigned")
        buckets.append(write_table(bucket_sizes(assigned, groups, params), "buckets"))
        sizes = read(BUCKET_SCHEMA, buckets[-1:])
        again, swallowed = sizes.agg(
            F.count_if(F.col("fate") == "split"), F.count_if(F.col("fate") == "chunk")
        ).first()
        placed = sorted_join(assigned, sizes.select("parent", "child", "path", "fate"), ["parent", "child"])
        rows.append(write_table(placed.select("path", "vec_id", "parent", "fate"), "rows"))
        here = read(ROW_SCHEMA, rows[-1:])
        if swallowed:
            cut = chunk_split(here.filter(F.col("fate") == "chunk"), setting_of(params, "cmax", "parent"))
            runs.append(write_table(cut, "runs"))
        if not again:
            break
        groups = sizes.filter(F.col("fate") == "split").select("path", "n")
        members = here.filter(F.col("fate") == "split").select("path", "vec_id")
        if unique:
            ended, groups = _within_tasks(members, points, groups, params, dim)
            carved += ended
            if groups is None:
                break
            members = sorted_join(members, groups.select("path"), "path", "left_semi")
        with_vectors = sorted_join(members, points, "vec_id")

    leaves = read(ROW_SCHEMA, rows).filter(F.col("fate") == "leaf").select("path", "vec_id")
    nodes = read(BUCKET_SCHEMA, buckets).filter(F.col("fate") != "chunk").select(
        "path", "parent", "representative",
        (F.col("fate") == "leaf").alias("is_leaf"), F.lit(False).alias("chunked"),
    )
    if runs:
        cut = read(RUN_SCHEMA, runs)
        heads = cut.groupBy("path", "parent").agg(F.min("vec_id").alias("representative"))
        chunked = heads.select("*", F.lit(True).alias("is_leaf"), F.lit(True).alias("chunked"))
        leaves = leaves.unionByName(cut.select("path", "vec_id"))
        nodes = nodes.unionByName(materialize(chunked, "chunk_nodes"))
    if carved:
        below = read(CARVED_SCHEMA, carved)
        leaves = leaves.unionByName(below.filter("is_leaf IS NULL").select("path", "vec_id"))
        inner = below.filter("is_leaf IS NOT NULL").withColumnRenamed("vec_id", "representative")
        nodes = nodes.unionByName(inner)
        depth = nodes.agg(F.max(F.length("path"))).first()[0] // DIGITS - 1
    if small:
        leaves, nodes = leaves.unionByName(whole), nodes.unionByName(single)
    return Forest(leaves, nodes, depth, replicas)


def _ids_differ(points: DataFrame) -> bool:
    """Whether every id has one row. Rows that share an id meet at every join, and so once per level."""
    return points.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _within_tasks(members, points, groups, params: CarveRoots, dim: int):
    """Carve to the end, one task each, all groups whose different vectors fill a block at most.

    A larger group of at most ``sliceRows`` points is known by its different vectors, and the
    ids of each. Returns the tables written (``CARVED_SCHEMA``), and the groups left or None.
    """
    spark = points.sparkSession
    most, slice_rows = block_rows(spark, dim), setting(spark, SLICE_ROWS)
    groups = materialize(groups, "groups")
    crowded = groups.filter((F.col("n") > most) & (F.col("n") <= slice_rows)).select("path")
    fit = groups.filter(F.col("n") <= most).select("path")
    of = lambda some: sorted_join(sorted_join(members, some, "path", "left_semi"), points, "vec_id")
    held = of(fit).select("path", "v", F.array("vec_id").alias("ids"))
    if not crowded.isEmpty():
        copies = materialize(of(crowded).groupBy("path", "v").agg(F.collect_list("vec_id").alias("ids")), "copies")
        few = copies.groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select("path")
        few = materialize(few, "crowded")
        fit = fit.unionByName(few)
        held = held.unionByName(sorted_join(copies, few, "path", "left_semi"))
    if fit.isEmpty():
        return [], groups
    left = sorted_join(groups, fit, "path", "left_anti")
    task = _CarveTask(params)
    written = write_table(held.groupBy("path").applyInArrow(lambda table: task.run(table), CARVED_SCHEMA), "carved")
    left = materialize(left, "groups-left")
    return [written], None if left.isEmpty() else left


class _CarveTask:
    """Carves one group that a task holds, by the rules of ``carve``."""

    def __init__(self, params: CarveRoots):
        self.metric = params.metric
        self.roots = [params.values(n) for n in ("cmax", "leader_frac", "max_leaders", "seed")]

    def run(self, table: pa.Table) -> pa.Table:
        path, lists = table.column("path")[0].as_py(), blocks.column(table, "ids")
        root = int(path[:DIGITS], 16)
        cmax, share, most, seed = (values[root] for values in self.roots)
        vectors, ids = blocks.matrix(table, "v"), lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy(zero_copy_only=False))
        names = [str(i).encode() for i in ids]
        nodes, leaves, waiting = [], [], [(path, np.arange(len(ids)))]
        while waiting:
            path, group = waiting.pop()
            wanted = min(max(2, int(np.float32(len(group)) * np.float32(share))), most, len(group))
            chosen = group[_first_by_hash(f"{seed}:{path[DIGITS:]}{':' if path[DIGITS:] else ''}", names, ids, group, wanted)]
            kinds, kind = np.unique(owner[group], return_inverse=True)
            _, at, _ = blocks.nearest(vectors[kinds], np.zeros(len(kinds), np.int64), vectors[owner[chosen]], ids[chosen], 1, self.metric)
            child = at[kind]
            if (child == child[0]).all():
                run = np.sort(ids[group])
                for c, start in enumerate(range(0, len(run), cmax)):
                    name = f"{path}{c:0{DIGITS}x}"
                    nodes.append((name, path, run[start], True, True))
                    leaves.append((name, run[start : start + cmax]))
                continue
            group = group[np.argsort(child, kind="stable")]
            numbers, sizes = np.unique(child, return_counts=True)
            for number, bucket in zip(numbers, np.split(group, np.cumsum(sizes)[:-1])):
                name = f"{path}{number:0{DIGITS}x}"
                nodes.append((name, path, ids[chosen[number]], len(bucket) <= cmax, False))
                if len(bucket) <= cmax:
                    leaves.append((name, ids[bucket]))
                else:
                    waiting.append((name, bucket))
        return _carved(nodes, leaves)


def _first_by_hash(prefix: str, names, ids, group, count: int) -> np.ndarray:
    """The places in ``group`` of the first ``count`` ids in the order of ``sampling_hash``."""
    begun, digests = hashlib.md5(prefix.encode()), []
    for i in group.tolist():
        one = begun.copy()
        one.update(names[i])
        digests.append(one.digest())
    high, low = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).T.astype(np.uint64)
    near = np.flatnonzero(high <= np.partition(high, count - 1)[count - 1])
    return near[np.lexsort((ids[group[near]], low[near], high[near]))[:count]]


def _carved(nodes, leaves) -> pa.Table:
    """Nodes and leaf rows as one table of ``CARVED_SCHEMA``."""
    path, parent, first, is_leaf, chunked = zip(*nodes)
    sizes, none = [len(found) for _, found in leaves], pa.nulls
    rows = pa.array([name for name, _ in leaves]).take(pa.array(np.repeat(np.arange(len(leaves)), sizes)))
    names = ["path", "parent", "vec_id", "is_leaf", "chunked"]
    ids = np.concatenate([found for _, found in leaves])
    below = [rows, none(len(rows), pa.string()), pa.array(ids), none(len(rows), pa.bool_()), none(len(rows), pa.bool_())]
    above = [pa.array(path), pa.array(parent), pa.array(np.array(first, np.int64)), pa.array(is_leaf), pa.array(chunked)]
    return pa.concat_tables([pa.table(above, names=names), pa.table(below, names=names)])


def _root_paths(roots) -> Column:
    """The paths of some roots, as a constant list."""
    return F.array(*[F.lit(f"{r:0{DIGITS}x}") for r in roots]).cast("array<string>")


def nearest_children(
    points: DataFrame, children: DataFrame, count: int, metric: str = "l2"
) -> DataFrame:
    """The ``count`` nearest children of the node each point is at.

    ``points`` has ``parent, vec_id, v``; ``children`` are nodes with their
    representative's vector ``v``. Ranked by (score, representative id).
    """
    queries = points.select("parent", F.col("vec_id").alias("query_id"), "v")
    base = children.select(
        "parent",
        F.col("representative").alias("vec_id"),
        "v",
        F.conv(F.substring("path", -DIGITS, DIGITS), 16, 10).cast("bigint").alias("child"),
    )
    found = topk_join(queries, base, count, metric, group="parent", carry="child")
    return found.select(
        F.col("query_id").alias("vec_id"),
        F.concat("parent", digits("child")).alias("path"),
        "rank",
    )


def route_to_leaf(
    at: DataFrame, points: DataFrame, nodes: DataFrame, depth: int, metric: str = "l2"
) -> DataFrame:
    """Follow the nearest child from node ``path`` down to a leaf, keeping other columns.

    ``at`` has ``path, vec_id`` and any columns; at most one row per point may
    be inside any subtree. Only rows still at an inner node move on: a level at a
    time, or in one pass where the nodes were counted to fit ``broadcastBytes`` with their vectors.
    """
    if depth <= 1:
        return at
    kinds = nodes.select("path", "is_leaf")
    children = sorted_join(nodes, points.withColumnRenamed("vec_id", "representative"), "representative")
    tagged = sorted_join(at, kinds, "path")
    schema, steps = tagged.schema, []
    tree = None
    if footprint(children)[1] <= setting(at.sparkSession, BROADCAST_BYTES) and _ids_differ(points):
        columns = children.select("path", "parent", F.col("representative").alias("vec_id"), "v", "is_leaf")
        tree = at.sparkSession.sparkContext.broadcast(columns.toArrow())
    while True:
        steps.append(write_table(tagged.select(*schema.names), "routing"))
        inner = at.sparkSession.read.schema(schema).parquet(steps[-1]).filter(~F.col("is_leaf"))
        if inner.isEmpty():
            break
        if tree is not None:
            whole = sorted_join(inner, points.select("vec_id", F.col("v").alias("_v")), "vec_id").select(*schema.names, "_v")
            tagged = whole.mapInArrow(_routed_to_the_end(tree, metric), schema)
            continue
        here = inner.drop("is_leaf").withColumnRenamed("path", "parent")
        step = nearest_children(sorted_join(here, points, "vec_id"), children, 1, metric).drop("rank")
        step = step.withColumn("parent", F.expr(f"left(path, length(path) - {DIGITS})"))
        tagged = sorted_join(sorted_join(here, step, ["parent", "vec_id"]).drop("parent"), kinds, "path")
    every = at.sparkSession.read.schema(schema).parquet(*steps)
    return every.filter("is_leaf").drop("is_leaf")


def _routed_to_the_end(tree, metric):
    """Moves rows from node ``path`` to the leaf below by their vectors ``_v``; rows without one are left out."""

    def run(batches):
        nodes = tree.value
        names, is_leaf = blocks.column(nodes, "path"), blocks.numbers(nodes, "is_leaf")
        place = {name: i for i, name in enumerate(names.to_pylist())}
        reps, vectors = blocks.numbers(nodes, "vec_id"), blocks.matrix(nodes, "v")
        parents = np.array([place.get(name, -1) for name in blocks.column(nodes, "parent").to_pylist()], np.int64)
        # Roots are no nodes, and nothing is routed from there.
        by = np.argsort(parents, kind="stable")
        edges = np.searchsorted(parents[by], np.arange(len(parents) + 1))
        for table in _gathered(batches, _ROUTED_ROWS):
            here = np.array([place.get(name, -1) for name in blocks.column(table, "path").to_pylist()], np.int64)
            rows, wanted = np.flatnonzero(here >= 0), blocks.matrix(table, "_v")
            ended = []
            while len(rows):
                done = is_leaf[here[rows]]
                ended.append(rows[done])
                rows = rows[~done]
                rows = rows[np.argsort(here[rows], kind="stable")]
                moved = []
                for some in np.split(rows, np.flatnonzero(np.diff(here[rows])) + 1) if len(rows) else []:
                    children = by[edges[here[some[0]]] : edges[here[some[0]] + 1]]
                    r, c, _ = blocks.nearest(
                        wanted[some], np.zeros(len(some), np.int64), vectors[children], reps[children], 1, metric
                    )
                    here[some[r]] = children[c]
                    moved.append(some[r])
                rows = np.concatenate(moved) if moved else rows
            at = pa.array(np.sort(np.concatenate(ended)) if ended else np.zeros(0, np.int64))
            out = table.drop_columns(["_v"]).take(at)
            columns = {"path": names.take(pa.array(here).take(at)), "is_leaf": pa.array(np.ones(len(at), bool))}
            for name, values in columns.items():
                out = out.set_column(out.schema.get_field_index(name), name, values)
            yield from out.combine_chunks().to_batches()

    return run


def _gathered(batches, rows: int):
    """Batches put together to tables of some ``rows`` rows, as every group of a table takes a step of its own."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def overlap(points: DataFrame, forest: Forest, params: CarveParams | CarveRoots) -> DataFrame:
    """Home leaves plus up to ``fanout - 1`` further leaves per point and replica.

    The further leaves are where the point is routed from its ``fanout``
    nearest children of the root, nearest child first, the home leaf excepted.
    A root with fewer children than ``fanout`` adds at most one leaf less than
    it has children.
    """
    params = CarveRoots.of(params, forest.replicas)
    fanouts = params.values("fanout")
    if max(fanouts) <= 1 or forest.depth == 0:
        return forest.leaves
    nodes = forest.nodes
    top = nodes.filter(F.length("path") == 2 * DIGITS)
    reps = top.join(points.withColumnRenamed("vec_id", "representative"), "representative")
    wide = [r for r, fanout in enumerate(fanouts) if fanout > 1]
    start = points.withColumn("parent", F.explode(_root_paths(wide)))
    picks = nearest_children(start, reps, max(fanouts), params.metric)
    picks = picks.filter(F.col("rank") <= setting_of(params, "fanout"))
    routed = route_to_leaf(picks, points, nodes, forest.depth, params.metric)
    elsewhere = sorted_join(routed, forest.leaves, ["path", "vec_id"], "left_anti").withColumn(
        "replica", replica_of()
    )
    order = W.partitionBy("replica", "vec_id").orderBy("rank")
    # One row per replica.
    children = top.groupBy(replica_of().alias("replica")).agg(F.count(F.lit(1)).alias("_children"))
    extra = (
        elsewhere.withColumn("_pick", F.row_number().over(order))
        .join(F.broadcast(children), "replica")
        .filter(F.col("_pick") <= F.least(setting_of(params, "fanout"), F.col("_children")) - 1)
    )
    return forest.leaves.unionByName(extra.select("path", "vec_id"))


def number_leaves(nodes: DataFrame) -> DataFrame:
    """Depth-first leaf numbers per replica: ``path, replica, leaf_id``."""
    leaves = nodes.filter("is_leaf").select(replica_of().alias("replica"), "path")
    return positions(leaves, ["replica"], ["path"]).select(
        "path", "replica", (F.col("pos") - 1).alias("leaf_id")
    )


@dataclass
class Partition:
    """Leaf rows ``replica, leaf_id, vec_id`` (overlap included) and tree nodes."""

    leaves: DataFrame
    nodes: DataFrame


def build_partition(
    points: DataFrame, params: CarveParams | CarveRoots, replicas: int = 1
) -> Partition:
    """Carve, overlap and number the leaves. Empty input gives empty tables.

    With ``CarveRoots``, ``replica`` is the number of the root.
    """
    forest = carve(points, params, max(1, replicas))
    rows = overlap(points, forest, params)
    leaves = sorted_join(rows, number_leaves(forest.nodes), "path")
    return Partition(
        materialize(leaves.select("replica", "leaf_id", "vec_id"), "leaves"), forest.nodes
    )


def point_memberships(leaves: DataFrame) -> DataFrame:
    """The sorted leaf numbers of every point and replica."""
    return leaves.groupBy("replica", "vec_id").agg(
        F.array_sort(F.collect_set("leaf_id")).alias("leaf_ids")
    )


def partition_stats(partition: Partition) -> DataFrame:
    """Leaf and membership counters, one row per replica."""
    per_leaf = (
        partition.leaves.groupBy("replica", "leaf_id")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("replica")
        .agg(
            F.count(F.lit(1)).alias("leaf_count"),
            F.sum("size").alias("assignment_total"),
            F.min("size").alias("min_leaf_size"),
            F.max("size").alias("max_leaf_size"),
        )
    )
    per_point = (
        partition.leaves.groupBy("replica", "vec_id")
        .agg(F.count(F.lit(1)).alias("membership"))
        .groupBy("replica")
        .agg(
            F.count_if(F.col("membership") > 1).alias("points_with_overlap"),
            F.max("membership").alias("max_membership"),
        )
    )
    chunks = partition.nodes.groupBy(replica_of().alias("replica")).agg(
        F.count_if("chunked").alias("fallback_chunk_splits")
    )
    return per_leaf.join(per_point, "replica").join(chunks, "replica")
