"""Near-duplicate points by range search on a robust-pruned flat graph.

Works on the library's points (``vec_id, v``) and speaks of leaders, edges
(``src, dst``) and degrees as the graph operators do; similarity is the cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.components import connected_components
from nearfield.runtime import hot_key_join, materialize


@dataclass(frozen=True)
class RangeGraphParams:
    """``shard_rows`` is the largest shard that is not cut, ``fanout`` the shards of a point at a split.

    ``max_degree`` and ``alpha`` prune the adjacency lists, ``beam`` bounds the
    greedy phase of the search. The audit compares points with all points until
    ``audit_rows`` of them have a link, or ``audit_limit`` were compared; below
    ``recall`` the search is repeated with a larger fanout, up to
    ``max_fanout``, and then without graph and bound on the fanout.
    """

    cosine: float = 0.95
    shard_rows: int = 1200
    max_leaders: int = 512
    fanout: int = 2
    max_fanout: int = 4
    max_degree: int = 24
    alpha: float = 1.2
    beam: int = 8
    audit_rows: int = 256
    audit_limit: int = 65_536
    recall: float = 0.97


def _finite(v):
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def point_classes(points: DataFrame) -> DataFrame:
    """``node, v, weight, first_id``: every different usable vector once, scaled to length one.

    Vectors that are null or zero, or hold null or non-finite components, and
    rows without ``vec_id`` are left out. ``node`` is the hash of the vector.
    """
    v = F.col("v").cast("array<double>")
    peak = F.array_max(F.transform(v, F.abs))
    rows = points.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & _finite(F.col("v")), F.lit(False))
    )
    rows = rows.filter(F.array_max(F.transform("v", F.abs)) > 0)
    rows = rows.withColumn("node", F.xxhash64("v"))
    once = rows.groupBy("node").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id")
    )
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    once = once.withColumn("_peak", peak).withColumn(
        "v", F.transform("v", lambda x: x / F.col("_peak"))
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    once = once.withColumn("_length", length)
    return once.withColumn("v", F.transform("v", lambda x: x / F.col("_length"))).drop("_length", "_peak")


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table["v"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _near_leaders(score: np.ndarray, fanout: int | None, cosine: float) -> np.ndarray:
    """Which leaders every row goes to: of its ``fanout`` nearest (None: of all) those within the margin.

    Of two linked points take the one nearer to its nearest leader: that leader
    is at most the link's angle farther from the other point than the other's
    own nearest. Leaders beyond this margin are never needed, and without a
    bound on the fanout every linked pair shares a leader.
    """
    angle = np.arccos(np.clip(score, -1, 1))
    margin = np.arccos(np.clip(cosine, -1, 1)) + 1e-6
    inside = angle <= angle.min(axis=1, keepdims=True) + margin
    if fanout is None or fanout >= score.shape[1]:
        return inside
    first = np.argpartition(-score, fanout - 1, axis=1)[:, :fanout]
    near = np.zeros_like(inside)
    np.put_along_axis(near, first, True, axis=1)
    return near & inside


def overlapping_shards(classes: DataFrame, params: RangeGraphParams, fanout: int | None) -> DataFrame:
    """``shard, node``: each point in the shards of its nearest leaders, at every split.

    Points of one dimension form the first shard. A shard above ``shard_rows``
    is split at leaders drawn by hash, at most about ``max_leaders``, of which
    those near an earlier one are dropped: a dense group has one leader and
    stays together. A shard with a single leader, or whose parts would overlap
    so much that nothing is saved, is left as it is, and the search cuts it
    into blocks and compares all of them. Leaders and slices of a shard meet in
    tasks of bounded size.
    """
    rows = materialize(
        classes.select(F.size("v").cast("bigint").alias("shard"), "node", "v"), "shard-rows"
    )
    done, level = None, 0
    while True:
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
        sizes = materialize(sizes.filter(F.col("_n") > params.shard_rows), "large-shards")
        if not sizes.isEmpty():
            leaders = materialize(_leaders(rows, sizes, level, fanout, params), "leaders")
            split = leaders.groupBy("shard").count().filter("count > 1").select("shard")
            sizes = materialize(sizes.join(split, "shard"), "split-shards")
        whole = rows.join(sizes, "shard", "left_anti").select("shard", "node")
        done = whole if done is None else done.unionByName(whole)
        if sizes.isEmpty():
            return done
        rows = materialize(_split(rows, sizes, leaders, fanout, params.cosine), "shard-rows")
        level += 1


def _leaders(rows, sizes, level, fanout, params) -> DataFrame:
    """``shard, leader, v``: leaders of the large shards, none near another of its shard.

    A single one where the drawn rows show that a split would not halve the
    pairs to compare, or would make more than ``max_fanout`` copies of a row.
    """
    cosine, most = params.cosine, params.max_fanout
    large = hot_key_join(rows, sizes, ["shard"], "node")
    parts = F.ceil(F.col("_n") * 3 * (fanout or most) / params.shard_rows)
    wanted = F.least(F.lit(params.max_leaders), parts)
    draw = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = large.filter(draw < F.greatest(wanted, F.lit(8)) / F.col("_n"))

    def thin(drawn: pa.Table) -> pa.Table:
        drawn = drawn.sort_by("node")
        v, kept = _matrix(drawn), []
        for i in range(len(v)):
            if not kept or (v[kept] @ v[i]).max() < 0.8:
                kept.append(i)
        if len(kept) > 1:
            score = v @ v[kept].T
            score[kept, np.arange(len(kept))] = -1  # a leader stands for rows that are none
            near = _near_leaders(score, fanout, cosine)
            share = near.mean(axis=0)
            if (share * share).sum() > 0.5 or share.sum() > most:
                kept = kept[:1]
        return drawn.take(pa.array(kept)).rename_columns(["shard", "leader", "v"])

    fields = "shard bigint, leader bigint, v array<double>"
    return drawn.select("shard", "node", "v").groupBy("shard").applyInArrow(thin, fields)


def _split(rows, sizes, leaders, fanout, cosine) -> DataFrame:
    """Rows of the large shards, each in the new shards of its nearest leaders."""
    cut = F.ceil(F.col("_n") / F.lit(20_000)).cast("int")
    members = hot_key_join(rows, sizes, ["shard"], "node").withColumn(
        "slice", F.pmod(F.xxhash64("node"), cut).cast("int")
    )
    spread = sizes.select("shard", F.explode(F.sequence(F.lit(0), cut - 1)).alias("slice"))
    leaders = leaders.join(spread, "shard")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left.select(["shard", "node", "v"])
        right = right.sort_by("leader")
        score = _matrix(left) @ _matrix(right).T
        row, near = np.nonzero(_near_leaders(score, fanout, cosine))
        with np.errstate(over="ignore"):
            child = left["shard"].to_numpy()[row] * np.int64(6364136223846793005)
            child = child + right["leader"].to_numpy()[near]
        out = left.select(["node", "v"]).take(pa.array(row))
        return out.add_column(0, "shard", pa.array(child))

    fields = "shard bigint, node bigint, v array<double>"
    split = members.select("shard", "slice", "node", "v").groupBy("shard", "slice")
    return split.cogroup(leaders.groupBy("shard", "slice")).applyInArrow(assign, fields)


def _cells(shards: DataFrame, classes: DataFrame, params: RangeGraphParams) -> DataFrame:
    """Rows of every shard; a dense shard above the limit as all pairs of its blocks."""
    counts = shards.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / params.shard_rows).alias("_cuts"))
    counts = materialize(counts.filter("_cuts > 1").select("shard", F.col("_cuts").cast("int")), "cuts")
    homes = shards.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("homes"))
    rows = shards.join(homes, "node")
    one = F.lit(1)
    rows = rows.join(counts, "shard", "left").withColumn("_cuts", F.coalesce("_cuts", one))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "_cuts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    rows = rows.select(
        "shard",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block", "node", "homes",
    )
    return rows.join(classes.select("node", "v", "weight"), "node")


def _robust_prune(sims: np.ndarray, degree: int, alpha: float, listed: int = 64) -> np.ndarray:
    """Adjacency of bounded degree: a neighbour is dropped where a kept one is much closer to it.

    Distances are one minus the cosine; rows are padded with -1.
    """
    m = len(sims)
    listed = min(listed, m - 1)
    out = np.full((m, degree), -1, np.int64)
    if listed < 1:
        return out
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    near = np.argpartition(-own, listed - 1, axis=1)[:, :listed]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable"), 1)
    dist = 1 - np.take_along_axis(own, near, 1)
    alive = np.ones((m, listed), bool)
    count = np.zeros(m, np.int64)
    rows = np.arange(m)
    for _ in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        r = rows[some]
        first = alive[r].argmax(axis=1)
        chosen = near[r, first]
        out[r, count[r]] = chosen
        count[r] += 1
        alive[r, first] = False
        between = 1 - sims[chosen[:, None], near[r]]
        alive[r] &= alpha * between > dist[r]
    return out


def build_adjacency(cells: DataFrame, params: RangeGraphParams) -> DataFrame:
    """``src, dsts``: the pruned lists of all shards, united per point.

    A list has at most ``max_degree`` entries per shard of its point.
    """
    degree, alpha = params.max_degree, params.alpha

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, v = rows["node"].to_numpy(), _matrix(rows)
        adjacency = _robust_prune(v @ v.T, degree, alpha)
        row, col = np.nonzero(adjacency >= 0)
        offsets = np.searchsorted(row, np.arange(len(nodes) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, nodes[adjacency[row, col]])
        return pa.table({"src": pa.array(nodes), "dsts": lists})

    lists = cells.groupBy("shard", "low", "high").applyInArrow(build, "src bigint, dsts array<bigint>")
    return lists.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("dsts"))).alias("dsts"))


def _greedy_range(sims: np.ndarray, adjacency: np.ndarray, cosine: float, beam: int) -> np.ndarray:
    """Which members every member finds within range, all queries in step.

    A best-first search from the medoid with a bounded beam first; then every
    found point within range is expanded, however many there are.
    """
    m = len(sims)
    rows = np.arange(m)
    medoid = int(sims.sum(axis=0).argmax())
    seen = np.zeros((m, m), bool)
    seen[:, medoid] = True
    seen[rows, rows] = True
    ids = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf)
    fresh = np.zeros((m, beam), bool)
    ids[:, 0], score[:, 0], fresh[:, 0] = medoid, sims[:, medoid], True
    while True:
        best = np.where(fresh, score, -np.inf)
        at = best.argmax(axis=1)
        active = rows[best[rows, at] > -np.inf]
        if not len(active):
            break
        node = ids[active, at[active]]
        fresh[active, at[active]] = False
        near = adjacency[node]
        known = (near < 0) | seen[active[:, None], near]
        seen[active[:, None], np.where(near < 0, active[:, None], near)] = True
        value = np.where(known, -np.inf, sims[active[:, None], near])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_score = np.concatenate([score[active], value], axis=1)
        all_fresh = np.concatenate([fresh[active], ~known], axis=1)
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        score[active] = np.take_along_axis(all_score, top, 1)
        fresh[active] = np.take_along_axis(all_fresh, top, 1)
    inside = sims >= cosine
    found = seen & inside
    links = np.zeros((m, m), np.float32)
    r, c = np.nonzero(adjacency >= 0)
    links[r, adjacency[r, c]] = 1
    # Range expansion may walk an edge either way, since the cosine is the same.
    links = np.maximum(links, links.T)
    frontier = found | found.T
    found = frontier.copy()
    while True:
        some = np.flatnonzero(frontier.any(axis=1))
        if not len(some):
            break
        reached = (frontier[some].astype(np.float32) @ links) > 0
        new = np.zeros_like(found)
        new[some] = reached & inside[some]
        new = (new | new.T) & ~found
        found |= new
        frontier = new
    np.fill_diagonal(found, False)
    return found & inside


def range_links(cells: DataFrame, adjacency: DataFrame | None, params: RangeGraphParams) -> DataFrame:
    """``node, n_links, root``: links of every point that a shard finds first, and one link to join them.

    A pair of points that share several shards is counted in the first of them
    alone, so no pair leaves its task. ``root`` is the least node that the
    point reaches inside the shard. Without ``adjacency`` all pairs of a cell
    are compared.
    """
    cosine, beam, exact = params.cosine, params.beam, adjacency is None

    def walk(rows: pa.Table, nodes: np.ndarray, sims: np.ndarray) -> np.ndarray:
        m = len(nodes)
        lists = rows["dsts"].combine_chunks()
        owner = np.repeat(np.arange(m), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        target = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(nodes, target), m - 1)
        here = nodes[at] == target
        owner, at = owner[here], at[here]
        width = int(np.bincount(owner, minlength=m).max()) if len(owner) else 1
        table = np.full((m, max(1, width)), -1, np.int64)
        table[owner, np.arange(len(owner)) - np.searchsorted(owner, owner)] = at
        return _greedy_range(sims, table, cosine, beam)

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, v = rows["node"].to_numpy(), _matrix(rows)
        m = len(nodes)
        sims = v @ v.T
        if exact:
            found = sims >= cosine
            np.fill_diagonal(found, False)
        else:
            found = walk(rows, nodes, sims)
        label = np.arange(m)
        while True:  # the least node in reach, over found links
            low = np.where(found, label[None, :], m).min(axis=1)
            new = np.minimum(label, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        block = rows["block"].to_numpy()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        counted = found.copy()
        if low != high:  # pairs inside a block are counted in the block's own cell
            counted &= block[:, None] != block[None, :]
        homes = rows["homes"].combine_chunks()
        shard = rows["shard"][0].as_py()
        several = np.flatnonzero(homes.value_lengths().to_numpy(zero_copy_only=False) > 1)
        earlier: dict[int, list[int]] = {}
        for i in several:
            for home in homes[int(i)].as_py():
                if home < shard:
                    earlier.setdefault(home, []).append(i)
        for members in earlier.values():
            if len(members) > 1:
                counted[np.ix_(members, members)] = False
        n = counted.astype(float) @ rows["weight"].to_numpy().astype(float)
        return pa.table(
            {"node": nodes, "n_links": n.astype(np.int64), "root": pa.array(nodes[label])}
        )

    fields = "node bigint, n_links bigint, root bigint"
    if not exact:
        cells = cells.join(adjacency.withColumnRenamed("src", "node"), "node", "left")
    return cells.groupBy("shard", "low", "high").applyInArrow(search, fields)


def audit(classes: DataFrame, found: DataFrame, params: RangeGraphParams) -> float | None:
    """Recall of the found links over points in hash order, each compared with all points.

    Goes on until ``audit_rows`` of the points have a link or all points were
    compared; None where ``audit_limit`` points did not show as many.
    """
    n = classes.count()
    if not n:
        return 1.0
    draw = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) / F.lit(1 << 30)
    width = classes.agg(F.max(F.size("v"))).first()[0]
    most = max(1, min(8192, (32 << 20) // (8 * width)))
    size, low, hits, true, linked = 4 * params.audit_rows, 0.0, 0, 0, 0
    while linked < params.audit_rows and low < 1:
        if low * n >= params.audit_limit:
            return None
        high = low + min(size, most) / n
        sample = classes.select("node", "v").filter((draw >= low) & (draw < high))
        row = _audited(classes, found, sample.toArrow(), params.cosine)
        hits, true, linked = hits + row[0], true + row[1], linked + row[2]
        size, low = 4 * size, high
    return hits / true if true else 1.0


def _audited(classes: DataFrame, found: DataFrame, table: pa.Table, cosine: float):
    """Found links, all links and linked points of the points in ``table``."""
    if not len(table):
        return 0, 0, 0
    shared = classes.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        table = shared.value
        lengths = table["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        total = np.zeros(len(table), np.int64)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            dims = rows["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                mine = np.flatnonzero(lengths == dim)
                if len(mine):
                    part = rows.take(pa.array(some))
                    hit = _matrix(table.take(pa.array(mine))) @ _matrix(part).T >= cosine
                    hit &= table["node"].to_numpy()[mine][:, None] != part["node"].to_numpy()[None, :]
                    total[mine] += hit @ part["weight"].to_numpy()
        yield pa.record_batch([table["node"].combine_chunks(), pa.array(total)], names=["node", "_true"])

    true = classes.select("node", "v", "weight").mapInArrow(count, "node bigint, _true bigint")
    true = true.groupBy("node").agg(F.sum("_true").alias("_true"))
    return true.join(found, "node", "left").agg(
        F.sum(F.least(F.coalesce("n_links", F.lit(0)), "_true")),
        F.sum("_true"),
        F.count(F.when(F.col("_true") > 0, 1)),
    ).first()


def near_duplicate_points(
    points: DataFrame, params: RangeGraphParams = RangeGraphParams()
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every point.

    Points link where the cosine of their vectors, in double precision, is at
    least ``params.cosine``; every link is verified, and the share of all links
    that is found is audited. Where no fanout reaches ``params.recall``, or too
    few links are seen to tell, all pairs that can link are compared. Equal vectors are one point of the graph and count
    by their number. ``component_id`` is the smallest ``vec_id`` in reach, its
    own included; ``kept`` marks that point. A vector that is null or zero, or
    has null or non-finite components, links with nothing; so do vectors of
    different dimension with each other. A row without ``vec_id`` has no links,
    no component and is not kept. Repeated rows are equal vectors, and each
    is kept or not as its id says. An empty table gives an empty table.
    """
    classes = materialize(point_classes(points), "point-classes")
    for fanout in [*range(params.fanout, params.max_fanout + 1), None]:
        shards = materialize(overlapping_shards(classes, params, fanout), "shards")
        cells = _cells(shards, classes, params)
        adjacency = None if fanout is None else build_adjacency(cells, params)
        parts = materialize(range_links(cells, adjacency, params), "shard-links")
        found = parts.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        if fanout is None:
            break
        recall = audit(classes, found, params)
        if recall is not None and recall >= params.recall:
            break
    components = connected_components(parts.select("node", "root"), "node", "root")
    labelled = classes.select("node", "weight", "first_id").join(components, "node", "left")
    labelled = labelled.join(found, "node", "left").select(
        "node",
        F.coalesce("component", "node").alias("_label"),
        "first_id",
        (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    labelled = materialize(labelled, "point-labels")
    roots = labelled.groupBy("_label").agg(F.min("first_id").alias("component_id"))
    done = materialize(
        hot_key_join(labelled, roots, ["_label"], "node").select("node", "n_links", "component_id"),
        "point-components",
    )
    v = F.col("v").cast("array<double>")
    rows = points.select(
        "vec_id", F.when(F.col("vec_id").isNotNull() & _finite(v), F.xxhash64(v)).alias("node")
    )
    linked = hot_key_join(rows.filter("node is not null"), done.withColumn("_hit", F.lit(True)), ["node"], "vec_id")
    linked = linked.select("vec_id", "n_links", "component_id")
    usable = done.select("node")
    alone = rows.filter("node is null").unionByName(
        rows.filter("node is not null").join(usable, "node", "left_anti").select("vec_id", "node")
    )
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
