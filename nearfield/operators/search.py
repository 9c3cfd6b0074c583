"""Best-first beam search over a neighbour graph, all queries together.

A graph counted to fit in twice ``broadcastBytes`` with its vectors, both as they
are sent, goes to all tasks as lists of positions, and each task runs its queries to the end. Up to
``_PART_LIMITS`` times ``broadcastBytes`` it does so as well, but the graph is shuffled, once to every part of
the queries, and never meets the driver. Beyond that size the search
goes in rounds over tables: the state of a query is one row whose arrays hold
at most about ``beam`` entries; a round looks up the lists of each query's
``prefetch`` best frontier nodes, scores the points not seen before in the blocks
of vectors that hold them, where a query sends its vector and its list of ids once, and lets
every query advance as far as its looked-up lists reach. Looking further ahead
saves rounds and never changes the order of expansion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from nearfield.functions import blocks
from nearfield.params import SearchParams
from nearfield.runtime import BROADCAST_BYTES, block_count, bucketed, materialize, setting, sorted_join

KEYS = ["graph_id", "query_id"]
#: Queries that a task searches in one step, and the most (query, point) marks it holds for them.
_TOGETHER, _SEEN = 512, 64_000_000
#: A graph with its vectors, in bytes as they are sent, may take that many times ``broadcastBytes``.
_GRAPH_LIMITS = 2
#: The same where each part of the queries has the graph shuffled to it, and parts of the queries per core.
_PART_LIMITS, _PARTS = 16, 2
_STATE = (
    "graph_id int, query_id bigint, beam int, "
    "expanded array<struct<d:double,id:bigint>>, "
    "frontier array<struct<d:double,id:bigint>>, "
    "lists array<struct<node:bigint,nbrs:array<bigint>>>, "
    "scores array<struct<id:bigint,d:double>>, "
    "done boolean"
)
_RESULT = "graph_id int, query_id bigint, rank int, vec_id bigint, d double"


def beam_search(
    edges: DataFrame, points: DataFrame, queries: DataFrame, params: SearchParams
) -> DataFrame:
    """Top-k of every query among the nodes its search expands.

    The search starts at ``entry``, always expands the nearest frontier node
    (ties by id) and stops after ``beam`` expansions or with an empty frontier.
    Result ``query_id, rank, vec_id, d``.
    """
    tagged = edges.withColumn("graph_id", F.lit(0))
    asked = queries.withColumn("graph_id", F.lit(0)).withColumn("beam", F.lit(params.beam))
    return search_graphs(tagged, points, asked, params).drop("graph_id")


def search_refined_graph(edges, points, queries, params: SearchParams) -> DataFrame:
    """Beam search on a degree-refined graph: the same search."""
    return beam_search(edges, points, queries, params)


def search_graphs(
    edges: DataFrame, points: DataFrame, queries: DataFrame, params: SearchParams
) -> DataFrame:
    """Beam search of ``queries`` (``graph_id, query_id, beam, v``) on several graphs at once."""
    spark = points.sparkSession
    empty = spark.createDataFrame([], _RESULT)
    if points.isEmpty():
        return empty
    if points.filter(F.col("vec_id") == params.entry).isEmpty():
        raise ValueError(f"entry node {params.entry} is not among the points")
    queries = queries.withColumn("graph_id", F.col("graph_id").cast("int"))
    limit = setting(spark, BROADCAST_BYTES)
    vector_bytes = points.agg(F.sum(F.size("v").cast("bigint") * _component_bytes(points) + 8).alias("n")).first()["n"]
    lists = _lookup_lists(edges)
    if vector_bytes <= max(_GRAPH_LIMITS, _PART_LIMITS) * limit:
        lists = materialize(lists, "lists")
        sizes = lists.groupBy("graph_id").agg((8 * F.count(F.lit(1)) + 4 * F.sum(F.size("nbrs"))).alias("n"))
        every, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if vector_bytes + every <= _GRAPH_LIMITS * limit:
            return _search_broadcast(lists, points, queries, params)
        if vector_bytes + largest <= _PART_LIMITS * limit:
            return _search_parts(lists, points, queries, params)
    if vector_bytes > limit:
        lists = bucketed(lists, ["graph_id", "src"], "lists")
    asked = queries.select(*KEYS, F.col("v").alias("_q"))
    grid = _grid(points, queries)
    state = _first_state(queries.filter("beam > 0"), points, params)
    finished = []
    while True:
        state = materialize(state, "search")
        if state.isEmpty():
            break
        finished.append(state.filter("done"))
        state = _round(state.filter(~F.col("done")), lists, grid, asked, params)
    results = [_answers(rows, params.topk) for rows in finished]
    whole = results[0] if results else empty
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole


def _component_bytes(points) -> int:
    return 4 if points.schema["v"].dataType.elementType == FloatType() else 8


def _lookup_lists(edges):
    """Every node's neighbours, each once and by id; how often and in what rank they are listed does not matter."""
    edges = edges.select(F.col("graph_id").cast("int").alias("graph_id"), "src", "dst")
    return edges.groupBy("graph_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def _grid(points, queries):
    """The points by the block that owns them, and the numbers of blocks and of parts that meet each.

    A part has fewer queries than a block has points, as they bring lists of ids, and large
    tables have parts enough for all cores.
    """
    spark = points.sparkSession
    n, dim = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = queries.count()
    owners, parts = block_count(spark, n, dim), block_count(spark, 4 * asked, dim)
    parts = max(1, parts, min(-(-spark.sparkContext.defaultParallelism // owners), asked // 1000))
    owned = points.select("vec_id", "v", _owner(F.col("vec_id"), owners).alias("owner"))
    return owned.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), owners, parts


def _owner(ids, owners: int):
    return F.pmod(F.xxhash64(ids), F.lit(owners)).cast("int")


def _first_state(queries, points, params):
    entry = points.filter(F.col("vec_id") == params.entry).select(
        F.col("vec_id").alias("id"), F.col("v").alias("_e")
    )
    metric = params.metric

    def score(batches):
        """Scored as all other points are, so that copies of the entry tie with it."""
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                d = blocks.pair_scores(blocks.matrix(batch, "_e"), blocks.matrix(batch, "v"), at, at, metric)
                kept = [batch.column(n) for n in ("graph_id", "query_id", "beam", "id")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(d)], names=["graph_id", "query_id", "beam", "id", "d"])

    start = queries.join(F.broadcast(entry), F.lit(True)).select(
        "graph_id", F.col("query_id").cast("bigint").alias("query_id"), F.col("beam").cast("int").alias("beam"), "id", "_e", "v"
    )
    start = start.mapInArrow(score, "graph_id int, query_id bigint, beam int, id bigint, d double").select(
        *KEYS, "beam", F.array(F.struct("d", "id")).alias("frontier")
    )
    nothing = {f.name: f.dataType for f in _schema(start)}
    return start.select(
        *KEYS,
        "beam",
        F.array().cast(nothing["expanded"]).alias("expanded"),
        "frontier",
        F.array().cast(nothing["lists"]).alias("lists"),
        F.array().cast(nothing["scores"]).alias("scores"),
        F.lit(False).alias("done"),
    )


def _schema(df):
    return df.sparkSession.createDataFrame([], _STATE).schema


def _round(active, lists, grid, asked, params):
    held = F.transform("lists", lambda x: x["node"])
    ahead = F.filter(
        F.slice("frontier", 1, params.prefetch), lambda x: ~F.array_contains(held, x["id"])
    )
    wanted = active.select(*KEYS, F.explode(F.transform(ahead, lambda x: x["id"])).alias("src"))
    # Many queries want the same nodes near the entry: each is looked up once.
    nodes = ["graph_id", "src"]
    at = sorted_join(wanted.select(*nodes).distinct(), lists, nodes, "left")
    looked_up = (
        sorted_join(wanted, at, nodes)
        .groupBy(*KEYS)
        .agg(
            F.collect_list(
                F.struct(
                    F.col("src").alias("node"),
                    F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"),
                )
            ).alias("new_lists")
        )
    )
    ready = sorted_join(active, looked_up, KEYS, "left")
    known = F.concat(*(F.transform(c, lambda x: x["id"]) for c in ("expanded", "frontier", "scores")))
    met = F.array_distinct(F.flatten(F.transform("new_lists", lambda x: x["nbrs"])))
    fresh = ready.select(*KEYS, F.array_except(met, known).alias("ids")).filter(F.size("ids") > 0)
    scored = _scored_lists(fresh, grid, asked, params.metric)
    return sorted_join(ready, scored, KEYS, "left").mapInArrow(_advance_rows, _STATE)


def _scored_lists(fresh, grid, asked, metric):
    """``new_scores`` of every query for its list of ids; ids without a vector are left out."""
    owned, owners, parts = grid
    share = lambda o: F.filter("ids", lambda x: _owner(x, owners) == o)
    by_owner = F.transform(F.sequence(F.lit(0), F.lit(owners - 1)), lambda o: F.struct(o.alias("owner"), share(o).alias("ids")))
    asking = (
        sorted_join(fresh, asked, KEYS)
        .select(*KEYS, "_q", F.inline(by_owner))
        .filter(F.size("ids") > 0)
        .withColumn("part", F.pmod(F.xxhash64(*KEYS), F.lit(parts)).cast("int"))
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = blocks.numbers(right, "vec_id")
        order = np.argsort(ids, kind="stable")
        row, wanted = _flat(blocks.column(left, "ids"))
        wanted = wanted.to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids[order], wanted)
        known = at < len(ids)
        known[known] = ids[order][at[known]] == wanted[known]
        row, at = row[known], order[at[known]]
        d = blocks.pair_scores(blocks.matrix(right, "v"), blocks.matrix(left, "_q"), at, row, metric) if len(row) else np.zeros(0)
        columns = [blocks.column(left, n) for n in KEYS]
        return pa.table([*columns, _listed(row, len(left), id=ids[at], d=d)], names=[*KEYS, "found"])

    schema = "graph_id int, query_id bigint, found array<struct<id:bigint,d:double>>"
    cells = ["owner", "part"]
    found = asking.groupBy(*cells).cogroup(owned.groupBy(*cells)).applyInArrow(score, schema)
    return found.groupBy(*KEYS).agg(F.flatten(F.collect_list("found")).alias("new_scores"))


def _advance_rows(batches):
    for batch in batches:
        if batch.num_rows:
            yield advance(batch)


def _flat(column) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of all entries of a list column; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def _pairs_of(column, first: str, second: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, values = _flat(column)
    return rows, *(values.field(n).to_numpy(zero_copy_only=False) for n in (first, second))


def _listed(rows: np.ndarray, count: int, **fields) -> pa.Array:
    """A list column of structs from entries in row order."""
    offsets = np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)
    values = [v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, names=list(fields)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of some ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def lockstep(rows, nodes, scores, budget, neighbours):
    """Best-first search of many queries together, one expansion of each per step.

    ``rows, nodes, scores`` are the frontiers to begin with, ``budget`` the
    expansions left per query. ``neighbours(rows, nodes)`` tells for the chosen
    node of every query whether its list is at hand, and gives the fresh nodes
    as ``rows, nodes, scores`` in order of rows. A query stops where a list is missing, the
    budget is spent or the frontier empty. Order is by (score, node).

    Returns the expansions ``rows, nodes, scores`` in order of steps and what is
    left of the frontiers, best first, no longer than the budget left.
    """
    count, budget = len(budget), np.asarray(budget, np.int64)
    none, inf = np.int64(2**62), np.inf
    fill, spent = np.zeros(count, np.int64), np.zeros(count, np.int64)
    wide = 2 * int(budget.max(initial=0)) + 64
    D, N = np.full((count, wide), inf), np.full((count, wide), none)

    def compact(room):
        """Sort all frontiers, drop what the budget cannot reach, and make room."""
        nonlocal D, N, fill
        by = np.argsort(N, axis=1, kind="stable")
        D, N = np.take_along_axis(D, by, 1), np.take_along_axis(N, by, 1)
        by = np.argsort(D, axis=1, kind="stable")
        D, N = np.take_along_axis(D, by, 1), np.take_along_axis(N, by, 1)
        held = np.minimum(np.isfinite(D).sum(axis=1), budget - spent)
        beyond = np.arange(D.shape[1])[None, :] >= held[:, None]
        D[beyond], N[beyond] = inf, none
        fill = held
        need = int(held.max(initial=0)) + room
        if need > D.shape[1]:
            more = need - D.shape[1]
            D = np.pad(D, ((0, 0), (0, more)), constant_values=inf)
            N = np.pad(N, ((0, 0), (0, more)), constant_values=none)

    def insert(rows, nodes, scores):
        if not len(rows):
            return
        sizes = np.bincount(rows, minlength=count)
        if int((fill + sizes).max()) > D.shape[1]:
            compact(int(sizes.max()))
        at = fill[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        D[rows, at], N[rows, at] = scores, nodes
        fill[:] = fill + sizes

    insert(rows, nodes, scores)
    out, active = [], np.flatnonzero(budget > 0)
    while len(active):
        # Consumed places hold inf; only the filled part can be chosen.
        reach = int(fill[active].max())
        if not reach:
            break
        d, n = D[active, :reach], N[active, :reach]
        best = d.min(axis=1)
        alive = np.isfinite(best)
        active, d, n, best = active[alive], d[alive], n[alive], best[alive]
        if not len(active):
            break
        pick = np.where(d == best[:, None], n, none).argmin(axis=1)
        node = n[np.arange(len(active)), pick]
        held, *fresh = neighbours(active, node)
        going = active[held]
        D[going, pick[held]] = inf
        N[going, pick[held]] = none
        spent[going] += 1
        out.append((going, node[held], best[held]))
        insert(*fresh)
        active = going[spent[going] < budget[going]]
    compact(0)
    left_rows, left_at = np.nonzero(np.isfinite(D))
    done = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return done, (left_rows, N[left_rows, left_at], D[left_rows, left_at])


def advance(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Expand nodes best first until each query reaches one whose list was not looked up."""
    count = batch.num_rows
    column = lambda name: batch.column(name)
    done_row, done_d, done_id = _pairs_of(column("expanded"), "d", "id")
    front_row, front_d, front_id = _pairs_of(column("frontier"), "d", "id")
    lists = [_flat(column(name)) for name in ("lists", "new_lists")]
    list_row = np.concatenate([rows for rows, _ in lists])
    list_node = np.concatenate([v.field("node").to_numpy(zero_copy_only=False) for _, v in lists])
    held = [v.field("nbrs") for _, v in lists]
    sizes = np.concatenate([h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for h in held]).astype(np.int64)
    near = np.concatenate([h.flatten().to_numpy(zero_copy_only=False) for h in held])
    scored = [_pairs_of(column(name), "id", "d") for name in ("scores", "new_scores")]
    score_row = np.concatenate([s[0] for s in scored] + [front_row])
    score_id = np.concatenate([s[1] for s in scored] + [front_id])
    score_d = np.concatenate([s[2] for s in scored] + [front_d])

    # A (query, node) pair is one number: nodes as positions among all ids of the batch, in id order.
    ids = np.unique(np.concatenate([done_id, front_id, list_node, near, score_id]).astype(np.int64))
    width = max(1, len(ids))
    code = lambda values: np.searchsorted(ids, values)
    list_key = list_row * width + code(list_node)
    by = np.argsort(list_key, kind="stable")
    list_key, starts, sizes = list_key[by], (np.cumsum(sizes) - sizes)[by], sizes[by]
    near = code(near)
    # A point without a score fell off the frontier and stays out of reach.
    score_key, by = np.unique(score_row * width + code(score_id), return_index=True)
    score_d = score_d[by]
    found = np.zeros(len(score_key), bool)
    done_key = done_row * width + code(done_id)
    found[np.isin(score_key, np.concatenate([done_key, front_row * width + code(front_id)]))] = True

    def neighbours(rows, nodes):
        asked = rows * width + nodes
        at = np.minimum(np.searchsorted(list_key, asked), max(0, len(list_key) - 1))
        held = list_key[at] == asked if len(list_key) else np.zeros(len(asked), bool)
        at, rows = at[held], rows[held]
        keys = np.repeat(rows * width, sizes[at]) + near[_ranges(starts[at], sizes[at])]
        keys = np.unique(keys)
        at = np.searchsorted(score_key, keys)
        known = at < len(score_key)
        known[known] = (score_key[at[known]] == keys[known]) & ~found[at[known]]
        at, keys = at[known], keys[known]
        found[at] = True
        return held, keys // width, keys % width, score_d[at]

    budget = column("beam").to_numpy(zero_copy_only=False) - np.bincount(done_row, minlength=count)
    (more_row, more_node, more_d), (row, node, d) = lockstep(front_row, code(front_id), front_d, budget, neighbours)

    by = np.argsort(np.concatenate([done_row, more_row]), kind="stable")
    all_row = np.concatenate([done_row, more_row])[by]
    all_id, all_d = np.concatenate([done_id, ids[more_node]])[by], np.concatenate([done_d, more_d])[by]
    # Lists of waiting nodes stay, with the scores of what they may add to the frontier.
    waiting = row * width + node
    kept = np.flatnonzero(np.isin(list_key, waiting))
    lengths = sizes[kept]
    flat = near[_ranges(starts[kept], lengths)]
    useful = np.unique(np.repeat(list_key[kept] // width * width, lengths) + flat)
    useful = np.setdiff1d(useful, np.concatenate([waiting, all_row * width + code(all_id)]))
    useful = useful[np.isin(useful, score_key)]
    nbrs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids[flat]))
    columns = [
        column("graph_id"), column("query_id"), column("beam"),
        _listed(all_row, count, d=all_d, id=all_id),
        _listed(row, count, d=d, id=ids[node]),
        _listed(list_key[kept] // width, count, node=ids[list_key[kept] % width], nbrs=nbrs),
        _listed(useful // width, count, id=ids[useful % width], d=score_d[np.searchsorted(score_key, useful)]),
        pa.array(np.bincount(row, minlength=count) == 0),
    ]
    names = ["graph_id", "query_id", "beam", "expanded", "frontier", "lists", "scores", "done"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _compact(lists, ids) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By graph: positions of nodes among the sorted ``ids``, lengths of their lists, and the lists as positions.

    Nodes and neighbours without a vector are left out. Four bytes each, as the graph is sent.
    """
    table = lists.filter("graph_id IS NOT NULL AND src IS NOT NULL").orderBy("graph_id", "src").toArrow()
    tag, src = blocks.numbers(table, "graph_id"), blocks.numbers(table, "src")
    row, dst = _flat(blocks.column(table, "nbrs"))
    dst = dst.to_numpy(zero_copy_only=False)
    at, sizes, near = _placed(ids, src, row, dst)
    ends = np.cumsum(sizes, dtype=np.int64)
    graphs = {}
    for number in np.unique(tag):
        first, end = np.searchsorted(tag, [number, number + 1])
        low, high = (ends[i - 1] if i else 0 for i in (first, end))
        graphs[int(number)] = (at[first:end], sizes[first:end], near[low:high])
    return graphs


def _placed(ids, src, row, dst) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of nodes and of their neighbours among the sorted ``ids``, and lengths of the lists, in four bytes.

    ``row`` tells the node of every neighbour. Lists of unknown nodes are emptied, unknown neighbours left out.
    """
    at, near = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    last = len(ids) - 1
    known = (ids[np.minimum(near, last)] == dst) & (ids[np.minimum(at, last)] == src)[row]
    return at.astype(np.int32), np.bincount(row[known], minlength=len(src)).astype(np.int32), near[known].astype(np.int32)


def _search_broadcast(lists, points, queries, params) -> DataFrame:
    spark = points.sparkSession
    vectors = points.select("vec_id", "v").toArrow()
    graph = spark.sparkContext.broadcast((vectors, _compact(lists, np.sort(blocks.numbers(vectors, "vec_id")))))
    del vectors
    component = _component(points)

    def run(batches):
        vectors, links = graph.value
        ids = blocks.numbers(vectors, "vec_id")
        held = _Held(ids, blocks.matrix(vectors, "v").astype(component), params)
        graphs = {number: held.linked(*lists) for number, lists in links.items()}
        alone = held.linked(*[np.zeros(0, np.int32)] * 3)
        for batch in batches:
            number = blocks.numbers(batch, "graph_id")
            for which in np.unique(number):
                rows = pa.array(np.flatnonzero(number == which))
                yield from held.search(graphs.get(int(which), alone), batch.take(rows))

    asked = queries.filter("beam > 0").select("graph_id", "query_id", "beam", "v")
    width = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return asked.repartition(width, "query_id").mapInArrow(run, _RESULT)


def _component(points):
    return np.float32 if _component_bytes(points) == 4 else np.float64


def _search_parts(lists, points, queries, params) -> DataFrame:
    """Queries in parts of one graph each; every part gets the points and its graph's lists by a shuffle.

    The parts follow the cores, so a larger graph is copied no more often than a small one, and
    what a task holds is bounded by the caller. Rows reach a task in any order: queries wait for the
    rest, and larger tables of them have more parts.
    """
    spark = points.sparkSession
    points = points.filter("vec_id IS NOT NULL").select("vec_id", "v")
    count, dim = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = queries.filter("beam > 0 AND graph_id IS NOT NULL").select("graph_id", "query_id", "beam", "v")
    # A row per graph.
    sizes = asked.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).orderBy("graph_id").collect()
    if not sizes:
        return spark.createDataFrame([], _RESULT)
    wanted, total = _PARTS * spark.sparkContext.defaultParallelism, sum(r["n"] for r in sizes)
    first, parts = {}, 0
    for r in sizes:
        share = min(-(-wanted * r["n"] // total), -(-r["n"] // _TOGETHER))
        first[r["graph_id"]] = (parts, max(share, block_count(spark, r["n"], dim)))
        parts += first[r["graph_id"]][1]
    by_graph = lambda at: F.create_map(*[F.lit(x) for g, held in first.items() for x in (g, held[at])])[F.col("graph_id")]
    start, held = by_graph(0), by_graph(1)
    every = lambda start, held: F.explode(F.sequence(start, start + held - 1)).alias("part")
    listed = lists.filter("src IS NOT NULL").filter(F.col("graph_id").isin(list(first)))
    rows = [
        points.select(every(F.lit(0), F.lit(parts)), F.col("vec_id").alias("id"), "v"),
        listed.select(every(start, held), F.col("src").alias("id"), "nbrs"),
        asked.select(
            (start + F.pmod(F.xxhash64("query_id"), held)).cast("int").alias("part"), "graph_id",
            F.col("query_id").cast("bigint").alias("id"), F.col("beam").cast("int").alias("beam"), F.col("v").alias("q"),
        ),
    ]
    whole = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    component = _component(points)

    def run(batches):
        ids, base, filled = np.empty(count, np.int64), np.empty((count, dim), component), 0
        links, waiting = [], []
        for batch in batches:
            listed, asking = (batch.column(n).is_valid() for n in ("nbrs", "beam"))
            kept = batch.filter(pc.invert(pc.or_(listed, asking)))
            if len(kept):
                end = filled + len(kept)
                ids[filled:end], base[filled:end] = blocks.numbers(kept, "id"), blocks.matrix(kept, "v")
                filled = end
            kept = batch.filter(listed)
            if len(kept):
                near = blocks.column(kept, "nbrs")
                links.append((blocks.numbers(kept, "id"), near.value_lengths().to_numpy(), near.flatten().to_numpy()))
            kept = batch.filter(asking)
            if len(kept):
                kept = kept.select(["graph_id", "id", "beam", "q"])
                waiting.append(kept.rename_columns(["graph_id", "query_id", "beam", "v"]))
        if not waiting:
            return
        held = _Held(ids, base, params)
        none = np.zeros(0, np.int64)
        src, sizes, near = (np.concatenate(c) for c in zip(*links)) if links else (none, none, none)
        del links
        order = np.argsort(src)
        starts = np.cumsum(sizes) - sizes
        near = near[_ranges(starts[order], sizes[order])]
        at, sizes, near = _placed(held.ids, src[order], np.repeat(np.arange(len(order)), sizes[order]), near)
        graph = held.linked(at, sizes, near)
        for batch in waiting:
            yield from held.search(graph, batch)

    return whole.repartitionById(parts, F.col("part")).drop("part").mapInArrow(run, _RESULT)


class _Held:
    """Vectors in a task: their ids in order, and the row of each among the vectors as they came."""

    def __init__(self, ids, base, params):
        self.rows = np.argsort(ids, kind="stable")
        self.ids, self.base = ids[self.rows], base
        self.topk, self.metric = max(0, params.topk), params.metric
        self.start = int(np.searchsorted(self.ids, params.entry))
        self.together = max(1, min(_TOGETHER, _SEEN // max(1, len(ids))))
        self.seen = None

    def linked(self, src, sizes, near):
        """Lists as the places where they start, for every id, and neighbours by place."""
        starts = np.zeros(len(self.ids) + 1, dtype=np.int64)
        some = sizes > 0
        starts[src[some] + 1] = sizes[some]
        return np.cumsum(starts), near

    def search(self, graph, batch):
        """The answers to a batch of queries of one graph."""
        if self.seen is None:
            self.seen = np.zeros((self.together, len(self.ids)), dtype=bool)
        names = ["graph_id", "query_id", "rank", "vec_id", "d"]
        wanted, beam = blocks.matrix(batch, "v"), blocks.numbers(batch, "beam")
        for at in range(0, len(wanted), self.together):
            part = slice(at, at + self.together)
            row, rank, node, d = _expand(self, *graph, wanted[part], beam[part])
            number, query = (batch.column(n).take(pa.array(row + at)) for n in names[:2])
            columns = [
                number.cast(pa.int32()), query.cast(pa.int64()),
                pa.array(rank, pa.int32()), pa.array(self.ids[node], pa.int64()), pa.array(d),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _expand(held, starts, near, queries, beam):
    """Top-k of some queries on a graph held in arrays: row, rank, node and score."""
    count, start, seen = len(queries), held.start, held.seen
    everyone = np.arange(count)
    score = lambda nodes, rows: blocks.pair_scores(held.base, queries, held.rows[nodes], rows, held.metric)
    marked = [(everyone, np.full(count, start))]
    seen[marked[0]] = True
    first = score(marked[0][1], everyone)

    def neighbours(rows, nodes):
        sizes = starts[nodes + 1] - starts[nodes]
        flat, owner = near[_ranges(starts[nodes], sizes)], np.repeat(rows, sizes)
        fresh = ~seen[owner, flat]
        flat, owner = flat[fresh], owner[fresh]
        seen[owner, flat] = True
        marked.append((owner, flat))
        return np.ones(len(rows), bool), owner, flat, score(flat, owner)

    begin = (everyone, np.full(count, start), first)
    (row, node, d), _ = lockstep(*begin, np.minimum(beam, len(held.ids)), neighbours)
    # The marks are taken back one by one: most of a large table of them was never touched.
    for pairs in marked:
        seen[pairs] = False
    order = np.lexsort((node, d, row))
    row, node, d = row[order], node[order], d[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    best = rank <= held.topk
    return row[best], rank[best], node[best], d[best]


def _answers(rows: DataFrame, topk: int) -> DataFrame:
    best = F.slice(F.array_sort("expanded"), 1, max(0, topk))
    return rows.select(*KEYS, F.posexplode(best).alias("_p", "hit")).select(
        *KEYS,
        (F.col("_p") + 1).cast("int").alias("rank"),
        F.col("hit.id").alias("vec_id"),
        F.col("hit.d").alias("d"),
    )
