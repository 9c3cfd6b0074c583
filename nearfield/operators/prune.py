"""Bounding the degree: one neighbour per hash bucket, or the nearest ones."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearfield.functions import blocks
from nearfield.functions.vectors import hyperplanes, residual_hash, valid_edges
from nearfield.operators.knn import footprint, top_per
from nearfield.params import PruneParams
from nearfield.runtime import BROADCAST_BYTES, SLICE_ROWS, block_count, materialize, setting, sorted_join

COUNTERS = ["self_skipped", "kept", "replaced", "evicted", "dropped", "final_degree"]


def score_edges(
    edges: DataFrame, points: DataFrame, metric: str = "l2", sources: DataFrame | None = None
) -> DataFrame:
    """Add the score ``d`` of every edge; edges at ids without a vector are dropped.

    ``src`` is the ``vec_id`` of a point, or of a row of ``sources`` where those are given.

    Points that are counted to fit the broadcast limit are sent to all tasks
    and the edges are scored where they lie. Beyond that every point belongs
    to a block; a source sends its vector and the list of its targets once to each block
    that owns some of them. A block meets its sources in parts of about its own
    size, so a vector is copied at most as often as there are blocks, or edges at it, whichever is fewer.
    """
    spark = edges.sparkSession
    n, size = footprint(points)
    other = 0 if sources is None else footprint(sources)[1]
    sources = points if sources is None else sources
    if size + other <= setting(spark, BROADCAST_BYTES):
        return _scored_in_place(edges, points, metric, None if sources is points else sources)
    owners = block_count(spark, n, size // (8 * n))
    rows = -(-n // owners)
    owner = lambda name: F.pmod(F.xxhash64(name), F.lit(owners)).cast("int")
    # A list holds at most about ``rows`` targets: longer ones are cut by their targets' hash.
    pairs = edges.select("src", "dst").distinct().withColumn("owner", owner("dst"))
    hot = pairs.groupBy("src", "owner").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_cuts"))
    hot = materialize(hot.filter("_cuts > 1"), "long-lists")
    cut = F.lit(0)
    if not hot.isEmpty():
        pairs = pairs.join(hot, ["src", "owner"], "left")
        cut = F.pmod(F.xxhash64(F.col("dst"), F.lit(1)), F.coalesce("_cuts", F.lit(1))).cast("int")
    lists = pairs.withColumn("_cut", cut).groupBy("src", "owner", "_cut").agg(F.collect_list("dst").alias("ids"))
    lists = materialize(lists, "target-lists")
    per_owner = lists.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    # One row per block.
    parts = F.broadcast(materialize(per_owner, "block-parts"))
    asking = sorted_join(lists, sources.select(F.col("vec_id").alias("src"), "v"), "src").join(parts, "owner")
    asking = asking.withColumn("part", F.pmod(F.xxhash64("src", "_cut"), F.col("_parts")).cast("int"))
    # Fresh columns, since both sides come from the same table.
    owned = points.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    owned = owned.withColumn("owner", owner("vec_id")).join(parts, "owner")
    owned = owned.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = blocks.numbers(right, "vec_id")
        lists = blocks.column(left, "ids")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(ids, kind="stable")
        at = np.searchsorted(ids[order], wanted)
        known = at < len(ids)
        known[known] = ids[order][at[known]] == wanted[known]
        row, at = row[known], order[at[known]]
        # ``pair_scores`` takes the first side's rows by position; scores are of (source, target).
        d = blocks.pair_scores(blocks.matrix(left, "v"), blocks.matrix(right, "v"), row, at, metric) if len(row) else np.zeros(0)
        return pa.table([blocks.column(left, "src").take(pa.array(row)), pa.array(ids[at]), pa.array(d)], names=["src", "dst", "d"])

    left = asking.select("owner", "part", "src", "ids", "v").groupBy("owner", "part")
    right = owned.select("owner", "part", "vec_id", "v").groupBy("owner", "part")
    scored = left.cogroup(right).applyInArrow(score, "src bigint, dst bigint, d double")
    return sorted_join(edges, scored, ["src", "dst"])


def _scored_in_place(edges: DataFrame, points: DataFrame, metric: str, sources: DataFrame | None) -> DataFrame:
    tables = [sources, points] if sources is not None else [points]
    shared = edges.sparkSession.sparkContext.broadcast([t.select("vec_id", "v").toArrow() for t in tables])
    schema = T.StructType([*edges.schema.fields, T.StructField("d", T.DoubleType())])

    def run(batches):
        sides = []
        for table in shared.value:
            ids = blocks.numbers(table, "vec_id")
            order = np.argsort(ids, kind="stable")
            sides.append((ids[order], blocks.matrix(table, "v")[order]))
        (left_ids, left), (right_ids, right) = sides[0], sides[-1]

        def place(ids, wanted):
            at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
            return at, (ids[at] == wanted) if len(ids) else np.zeros(len(wanted), bool)

        for batch in batches:
            a, has_a = place(left_ids, blocks.numbers(batch, "src"))
            b, has_b = place(right_ids, blocks.numbers(batch, "dst"))
            known = np.flatnonzero(has_a & has_b)
            d = blocks.pair_scores(left, right, a[known], b[known], metric) if len(known) else np.zeros(0)
            kept = batch.take(pa.array(known))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(d)], names=[*kept.schema.names, "d"])

    return edges.mapInArrow(run, schema)


def project(points: DataFrame, planes: list[list[float]]) -> DataFrame:
    """Inner products of every vector with the planes: ``vec_id, p``."""
    normals = np.array(planes, dtype=np.float64)

    def run(batches):
        for batch in batches:
            flat = np.zeros(0)
            if len(normals) and len(batch):
                # Summed in one order for every row, so that equal vectors have equal
                # products whatever batch they are in.
                vectors = blocks.matrix(batch, "v")
                products = np.zeros((len(vectors), len(normals)))
                for axis in range(vectors.shape[1]):
                    products += vectors[:, axis, None] * normals[None, :, axis]
                flat = products.ravel()
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(normals)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "p"])

    return points.select("vec_id", "v").mapInArrow(run, "vec_id bigint, p array<double>")


def plane_set(points: DataFrame, params: PruneParams) -> list[list[float]]:
    dim = points.agg(F.max(F.size("v")).alias("dim")).first()["dim"] or 0
    return hyperplanes(params.hash_bits, dim, params.seed)


def hash_edges(
    candidates: DataFrame, points: DataFrame, params: PruneParams, planes=None
) -> DataFrame:
    """Add ``hash``, the bucket of the step from ``src`` to ``dst``.

    Only the projections travel with the edges. The last join is on ``dst`` and
    is followed by a shuffle, so adaptive execution is free to split the
    partition of a much-cited target.
    """
    planes = plane_set(points, params) if planes is None else planes
    narrow = materialize(project(points, planes), "projections")
    source = narrow.select(F.col("vec_id").alias("src"), F.col("p").alias("_ps"))
    target = narrow.select(F.col("vec_id").alias("dst"), F.col("p").alias("_pt"))
    return (
        sorted_join(sorted_join(candidates, source, "src"), target, "dst")
        .withColumn("hash", residual_hash(F.col("_ps"), F.col("_pt"), planes))
        .drop("_ps", "_pt")
    )


def hash_prune(
    candidates: DataFrame, points: DataFrame, params: PruneParams, planes=None
) -> DataFrame:
    """Per source: the nearest candidate of each bucket, then the nearest buckets.

    ``candidates`` has ``src, dst`` and optionally the squared distance ``d``.
    Self edges are ignored. Result ``src, dst, d, rank``. Buckets are
    pre-aggregated before the shuffle, so a source with very many candidates
    costs one row per bucket and task.
    """
    if "d" not in candidates.columns:
        candidates = score_edges(candidates, points)
    hashed = hash_edges(candidates.filter("src <> dst"), points, params, planes)
    return keep_buckets(hashed, ["src"], params.max_degree)


def keep_buckets(hashed: DataFrame, keys: list[str], max_degree: int) -> DataFrame:
    best = hashed.groupBy(*keys, "hash").agg(F.min(F.struct("d", "dst")).alias("_best"))
    rows = best.select(*keys, "_best.dst", "_best.d")
    return top_per(rows, keys, ["d", "dst"], max(0, max_degree))


def refine_degree(
    candidates: DataFrame, points: DataFrame, max_degree: int, metric: str = "l2"
) -> DataFrame:
    """Per source: the nearest ``max_degree`` valid candidates, ``src, dst, d, rank``."""
    edges = valid_edges(candidates, points)
    if "d" not in edges.columns:
        edges = score_edges(edges, points, metric)
    return top_per(edges.select("src", "dst", "d"), ["src"], ["d", "dst"], max(0, max_degree))


def prune_counters(
    candidates: DataFrame, points: DataFrame, params: PruneParams, planes=None
) -> DataFrame:
    """What happened to the candidates of every source, scanned by ascending id.

    A candidate is *kept* if it enters the bucket table when it is met,
    *replaced* counts those that took over their bucket, *evicted* those that
    pushed out the farthest bucket of a full table, *dropped* the rest.
    """
    if "d" not in candidates.columns:
        candidates = score_edges(candidates, points)
    return count_scans(hash_edges(candidates, points, params, planes), params.max_degree)


def count_scans(hashed: DataFrame, max_degree: int) -> DataFrame:
    """``prune_counters`` of candidates that have their ``d`` and ``hash``.

    Sources are range-partitioned by (source, target), so a source of any size
    is scanned in pieces of about ``sliceRows`` candidates at most, by several
    tasks. The table at the start of a piece is the pruned result of everything
    before it, which is merged from the pieces' own pruned results.
    """
    spark = hashed.sparkSession
    hashed = materialize(hashed.select("src", "dst", "d", "hash"), "hashed")
    cuts = -(-hashed.count() // setting(spark, SLICE_ROWS))
    cuts = max(cuts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialize(
        hashed.repartitionByRange(cuts, "src", "dst").withColumn("piece", F.spark_partition_id()),
        "pieces",
    )
    spans = (
        pieces.groupBy("src")
        .agg(F.min("piece").alias("first"), F.max("piece").alias("last"))
        .filter("first < last")
    )
    # At most one source crosses each boundary of two pieces, which bounds ``spans``.
    inside = pieces.filter("src <> dst").join(F.broadcast(spans), "src", "left_semi")
    openings = _opening_tables(_piece_summaries(inside, max_degree), max_degree)
    openings = openings.groupBy("piece", "src").agg(F.collect_list(F.struct("d", "dst", "hash")).alias("_table"))
    scans = pieces.groupBy("piece", "src").agg(
        F.count_if(F.col("src") == F.col("dst")).alias("self_skipped"),
        F.sort_array(F.collect_list(F.when(F.col("src") != F.col("dst"), F.struct("dst", "d", "hash")))).alias("_scan"),
    )
    folded = sorted_join(scans, openings, ["piece", "src"], "left").withColumn("_end", _fold(max_degree))
    sums = [F.sum(f"_end.{c}").alias(c) for c in COUNTERS[1:-1]]
    return (
        folded.groupBy("src")
        .agg(F.sum("self_skipped").alias("self_skipped"), *sums)
        .withColumn("final_degree", F.expr("kept - replaced - evicted"))
    )


def _fold(max_degree: int) -> Column:
    """Column ``_scan`` followed through a bucket table of at most ``max_degree`` entries.

    The table starts as ``_table`` (null: empty); the result has it and the counters.
    """
    table = "array<struct<d:double,dst:bigint,hash:bigint>>"
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.coalesce(F.col("_table").cast(table), F.array().cast(table)).alias("table"),
        *[zero.alias(c) for c in COUNTERS[1:-1]],
    )

    def bind(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.transform(F.array(value), use)[0]

    def step(state: Column, x: Column) -> Column:
        held = F.filter(state["table"], lambda t: t["hash"] == x["hash"])
        full = F.size(state["table"]) >= max_degree

        def settle(met: Column) -> Column:
            """``met`` has the entry that must be beaten, and whether it is in the same bucket."""
            beaten, same = met["entry"], met["same"]
            nearer = F.struct(x["d"], x["dst"]) < F.struct(beaten["d"], beaten["dst"])
            enters = F.when(beaten.isNull(), ~full).otherwise(nearer)
            rest = F.filter(state["table"], lambda t: ~t["hash"].eqNullSafe(beaten["hash"]))
            entry = F.struct(x["d"].alias("d"), x["dst"].alias("dst"), x["hash"].alias("hash"))
            return F.struct(
                F.when(enters, F.array_append(rest, entry)).otherwise(state["table"]).alias("table"),
                (state["kept"] + enters.cast("bigint")).alias("kept"),
                (state["replaced"] + (enters & same).cast("bigint")).alias("replaced"),
                (state["evicted"] + (enters & ~same & full).cast("bigint")).alias("evicted"),
                (state["dropped"] + (~enters).cast("bigint")).alias("dropped"),
            )

        same = F.size(held) > 0
        beaten = F.when(same, F.get(held, F.lit(0))).when(full, F.array_max(state["table"]))
        return bind(F.struct(beaten.alias("entry"), same.alias("same")), settle)

    return F.aggregate("_scan", start, step)


def _piece_summaries(inside: DataFrame, max_degree: int) -> DataFrame:
    best = inside.groupBy("src", "piece", "hash").agg(F.min(F.struct("d", "dst")).alias("_best"))
    rows = best.select("src", "piece", "hash", "_best.dst", "_best.d")
    return top_per(rows, ["src", "piece"], ["d", "dst"], max(0, max_degree)).drop("rank")


def _opening_tables(summaries: DataFrame, max_degree: int) -> DataFrame:
    """For sources in several pieces: the bucket table each later piece starts with.

    A source contributes at most ``max_degree`` rows per piece here.
    """
    schema = "src bigint, piece int, hash bigint, dst bigint, d double"

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(table.column(n).to_pylist() for n in ("piece", "hash", "dst", "d", "src")))
        )
        out, state, at = [], {}, None
        for piece, code, dst, d, src in rows:
            if piece != at:
                state = dict(heapq.nsmallest(max_degree, state.items(), key=lambda e: e[1]))
                if at is not None:
                    out += [(src, piece, h, e[1], e[0]) for h, e in state.items()]
                at = piece
            state[code] = min(state.get(code, (d, dst)), (d, dst))
        columns = list(zip(*out)) if out else [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        names = ["src", "piece", "hash", "dst", "d"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return summaries.groupBy("src").applyInArrow(run, schema)


def prune_totals(counters: DataFrame) -> DataFrame:
    """Counters summed over all sources."""
    return counters.agg(
        F.sum("kept").alias("prune_kept"),
        F.sum("dropped").alias("prune_dropped"),
        F.sum("replaced").alias("prune_replaced"),
        F.sum("evicted").alias("prune_evicted"),
        F.sum("final_degree").alias("prune_final_edges"),
    )
