"""Exact nearest neighbours as a grouped top-k join.

``topk_join`` is the one place where vectors meet: brute-force search, leader
assignment, routing and in-leaf scoring are all "the k nearest base rows of
the same group". Spark moves and merges bounded blocks; numpy scores a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from nearfield.functions import blocks
from nearfield.params import check_metric
from nearfield.runtime import BROADCAST_BYTES, MOST_CUTS, block_rows, full_block_rows, materialize, setting

GROUP = "_group"
SLICES = 64
#: Rows that the answers of several groups are put together to, before they leave a task.
_OUT_ROWS = 50_000


def prelimited(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Without most rows that cannot be among the first ``k`` of their key.

    Spark itself limits a ranked group before the shuffle, but only up to a
    limit of its own. Above that, every key is ranked in slices first, so that
    the task of a hot key sorts at most ``SLICES * k`` rows of it.
    """
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return df
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    window = W.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_pos", F.row_number().over(window)).filter(F.col("_pos") <= k)
    return ranked.drop("_slice", "_pos")


def top_per(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Keep the first ``k`` rows of every key, numbered in column ``rank``."""
    df = prelimited(df, keys, order, k)
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def footprint(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the vectors of a table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    return row["n"], row["n"] * (row["dim"] or 0) * 8


def topk_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    group: str | None = None,
    exclude_self: bool = False,
    listed: str | None = None,
    keep: tuple[str, ...] = (),
    carry: str | None = None,
    broadcast_bytes: int | None = None,
    base_bytes: int | None = None,
    dim: int | None = None,
    within=None,
) -> DataFrame:
    """The ``k`` nearest ``base`` rows of every query row, by (score, id).

    ``queries`` has ``query_id, v``; ``base`` has ``vec_id, v``. With ``group``
    both sides also have that column and only equal groups meet. ``listed``
    names a query column with the base ids that may be returned, ``keep``
    query columns and ``carry`` a bigint base column to pass through. ``within``
    limits a query to the base rows with some values of a column: it names that column
    (``column``) and a query column it needs (``asked``), and its ``lists(rows)`` gives
    the offsets and values of a table of queries.

    Result: ``[group], query_id, [keep], vec_id, [carry], d, rank``. A query id
    may occur in several groups, once in each, and is ranked in each on its own.

    A side whose vectors were counted to fit in ``broadcastBytes`` is sent to
    all tasks and the other side is streamed with no shuffle. Otherwise both
    sides are cut into blocks of about ``blockBytes`` per group, so that a
    hot group becomes a grid of block pairs, and the blocks' top-k are merged.
    ``base_bytes`` passes on a size that the caller has already counted, and
    ``dim`` the dimension.
    """
    check_metric(metric)
    spark = queries.sparkSession
    if group is None:
        queries = queries.withColumn(GROUP, F.lit(0))
        base = base.withColumn(GROUP, F.lit(0))
    g = group or GROUP
    left_cols = [g, "query_id", "v", *keep] + ([listed] if listed else [])
    right_cols = [g, "vec_id", "v"] + ([carry] if carry else [])
    if within is not None:
        left_cols, right_cols = left_cols + [within.asked], right_cols + [within.column]
    queries = queries.select(*dict.fromkeys(left_cols))
    # Fresh columns, since both sides may come from the same table.
    base = base.select(*[F.col(c).alias(c) for c in right_cols])

    fields = [queries.schema[g], queries.schema["query_id"]]
    fields += [queries.schema[c] for c in keep]
    fields += [base.schema["vec_id"]] + ([base.schema[carry]] if carry else [])
    fields += [T.StructField("d", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    schema = T.StructType(fields)
    task = _BlockTask(g, list(keep), carry, listed, k, metric, exclude_self, schema.names, within)

    limit = setting(spark, BROADCAST_BYTES) if broadcast_bytes is None else broadcast_bytes
    if base_bytes is None:
        rows, base_bytes = footprint(base)
        dim = base_bytes // (8 * rows) if rows else 0
    if base_bytes <= limit:
        small = spark.sparkContext.broadcast(base.toArrow())
        ranked = queries.mapInArrow(task.stream_queries(small), schema)
    else:
        query_bytes = footprint(queries)[1] if listed is None and not keep else limit + 1
        if query_bytes <= limit:
            small = spark.sparkContext.broadcast(queries.toArrow())
            ranked = _merged(base.mapInArrow(task.stream_base(small), schema), g, k)
        else:
            if dim is None:
                dim = base.agg(F.max(F.size("v"))).first()[0] or 0
            ranked = _blocked(queries, base, g, task, schema, block_rows(spark, dim), full_block_rows(spark, dim))
    return ranked if group else ranked.drop(GROUP)


def _merged(parts: DataFrame, g: str, k: int) -> DataFrame:
    """One ranking per query from the rankings against parts of the base."""
    return top_per(parts, [g, "query_id"], ["d", "vec_id"], k)


def _blocked(queries, base, g, task, schema, rows: int, full: int) -> DataFrame:
    """Both sides cut into bounded blocks per group; every block pair is one task group.

    Only groups above ``rows`` are cut, so the table of cuts has at most
    one row per ``rows`` input rows and is usually empty. Blocks of both sides
    have the same size, which makes the fewest copies for a grid of its memory.
    Smaller blocks grow with their group beyond ``MOST_CUTS`` of them, up to
    ``blockBytes``: the copies of a row do not grow with the table before that.
    """
    most = max(rows, full)

    def cuts(df, name):
        n = F.count(F.lit(1))
        wanted = F.greatest(F.least(F.ceil(n / rows), F.lit(MOST_CUTS)), F.ceil(n / most))
        count = df.groupBy(g).agg(wanted.cast("int").alias(name))
        return count.filter(F.col(name) > 1)

    big = materialize(
        cuts(queries, "_qcuts").join(cuts(base, "_bcuts"), g, "full_outer"), "cuts"
    )
    if big.isEmpty():
        return queries.groupBy(g).cogroup(base.groupBy(g)).applyInArrow(task.cell(), schema)
    cells = [g, "_qcut", "_bcut"]
    queries = _cut(queries, big, g, "query_id", "_qcut", "_bcut").groupBy(*cells)
    base = _cut(base, big, g, "vec_id", "_bcut", "_qcut").groupBy(*cells)
    return _merged(queries.cogroup(base).applyInArrow(task.cell(), schema), g, task.k)


def _cut(df, big, g, spread, own, other) -> DataFrame:
    """Give each row its block number and a copy for every block of the other side."""
    one = F.lit(1)
    return (
        df.join(big, g, "left")
        .withColumn(own, F.pmod(F.xxhash64(spread), F.coalesce(own + "s", one)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other + "s", one) - 1)))
        .drop("_qcuts", "_bcuts")
    )


class _BlockTask:
    """Builds the functions that score one block of queries against one of base."""

    def __init__(self, group, keep, carry, listed, k, metric, exclude_self, names, within=None):
        self.within = within
        self.group, self.keep, self.carry, self.listed = group, keep, carry, listed
        self.k, self.metric, self.exclude_self, self.names = k, metric, exclude_self, names

    def score(self, left, right):
        """Score two Arrow tables of the same group into an output table."""
        allowed = None
        if self.listed:
            lists = blocks.column(left, self.listed)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            allowed = (offsets, lists.flatten().to_numpy(zero_copy_only=False))
        sides = (
            blocks.matrix(left, "v"), blocks.numbers(left, "query_id"),
            blocks.matrix(right, "v"), blocks.numbers(right, "vec_id"),
            self.k, self.metric, self.exclude_self,
        )
        if self.within:
            lists = lambda start, stop: self.within.lists(left.slice(start, stop - start))
            r, c, d = blocks.nearest_within(*sides, lists, blocks.numbers(right, self.within.column))
        else:
            r, c, d = blocks.nearest(*sides, allowed)
        out = [blocks.column(left, n).take(pa.array(r)) for n in [self.group, "query_id", *self.keep]]
        out += [
            blocks.column(right, n).take(pa.array(c))
            for n in ["vec_id"] + ([self.carry] if self.carry else [])
        ]
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        return pa.table(out + [pa.array(d), pa.array(rank, pa.int32())], names=self.names)

    def cell(self):
        task = self

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return task.score(left, right)

        return run

    def stream_queries(self, small):
        task = self

        def run(batches):
            parts = _by_group(small.value, task.group)
            for batch in batches:
                ready, held = [], 0
                for key, rows in _by_group(pa.Table.from_batches([batch]), task.group).items():
                    if key in parts:
                        ready.append(task.score(rows, parts[key]))
                        held += len(ready[-1])
                        if held >= _OUT_ROWS:
                            yield from pa.concat_tables(ready).combine_chunks().to_batches()
                            ready, held = [], 0
                if ready:
                    yield from pa.concat_tables(ready).combine_chunks().to_batches()

        return run

    def stream_base(self, small):
        task = self

        def run(batches):
            parts = _by_group(small.value, task.group)
            best = {}
            for batch in batches:
                for key, rows in _by_group(pa.Table.from_batches([batch]), task.group).items():
                    if key in parts:
                        found = task.score(parts[key], rows)
                        seen = [best[key], found] if key in best else [found]
                        best[key] = _best_of(pa.concat_tables(seen), task.k)
            for table in best.values():
                yield from table.combine_chunks().to_batches()

        return run


def _by_group(table: pa.Table, name: str) -> dict:
    """Split a table into one table per value of a column."""
    encoded = blocks.column(table, name).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    values = encoded.dictionary.to_pylist()
    if len(values) == 1:
        return {values[0]: table}
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(values) + 1))
    table = table.combine_chunks().take(pa.array(order))
    return {
        value: table.slice(edges[i], edges[i + 1] - edges[i]) for i, value in enumerate(values)
    }


def _best_of(table: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of every query id seen so far in this task."""
    ids, near, d = (blocks.numbers(table, n) for n in ("query_id", "vec_id", "d"))
    order = np.lexsort((near, d, ids))
    ids = ids[order]
    fresh = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0)) if len(ids) else ids
    return table.take(pa.array(order[(np.arange(len(ids)) - start) < k]))


def exact_topk(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Brute-force top-k of every query; a query that is in the base finds itself."""
    return topk_join(queries, base, k, metric).select("query_id", "rank", "vec_id", "d")


def exact_knn_graph(base: DataFrame, max_degree: int, metric: str = "l2") -> DataFrame:
    """The ``max(1, 4 * max_degree)`` nearest other points of every point, as edges."""
    queries = base.select(F.col("vec_id").alias("query_id"), "v")
    found = topk_join(queries, base, max(1, 4 * max_degree), metric, exclude_self=True)
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "d", "rank")


def ground_truth(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Truth lists ``query_id, rank, vec_id`` computed on the loaded base itself."""
    return exact_topk(base, queries, k, metric).drop("d")
