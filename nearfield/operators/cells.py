"""An approximate index to compare the graphs with: points stored by cell, probed where it is nearest.

The index is a folder of three tables: ``centres``, ``members`` partitioned by
cell, and ``about`` with one row that says how many cells a query must probe,
how many points it must compare there, and what share of true neighbours that
finds, measured when it was built. A member has a code of one byte per
component beside its vector: codes rank the points of the probed cells, and
only a query's best by code are compared as vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.functions import blocks
from nearfield.operators.carve import assign_to_leaders, digits, leaders_of_level
from nearfield.operators.knn import top_per, topk_join
from nearfield.operators.prune import score_edges
from nearfield.params import CarveParams
from nearfield.runtime import materialize, sorted_join, table_path

#: Queries whose probed cells are told at a time.
_TOGETHER = 2048
#: Queries that are compared with brute force to set the number of probes.
SAMPLE = 256
#: Steps of a code on each side of zero.
STEPS = 127
#: A shortlist is ``k`` times one of these: the first that holds the share ``KEPT`` of true neighbours.
FACTORS, KEPT = (1, 2, 4, 8, 16, 32), 0.99
_ABOUT = (
    "cells bigint, probes bigint, shortlist bigint, recall double, read double, compared double, "
    "points bigint, scale double, metric string"
)
_VECTOR = "vec_id bigint, code array<tinyint>, v array<{}>"


@dataclass
class CellIndex:
    """A stored index. In ``about``, ``recall`` is what was found of the sample's true
    neighbours, ``read`` the share of all points whose codes lie in the probed cells, ``compared``
    the share compared as vectors; recall and read are null where the probes were given."""

    path: str
    about: DataFrame
    centres: DataFrame
    members: DataFrame
    probes: int
    shortlist: int
    scale: float
    metric: str


def code_of(v, scale: float):
    """The components of a vector as whole steps of ``scale / STEPS``."""
    return F.transform(v, lambda x: F.floor(x.cast("double") / F.lit(scale) * STEPS + F.lit(0.5)).cast("tinyint"))


def in_steps(queries: DataFrame, scale: float) -> DataFrame:
    """Queries in the unit of the codes, so that both rank as the vectors would."""
    return queries.withColumn("v", F.transform("v", lambda x: x.cast("double") / F.lit(scale) * STEPS))


def probe_sample(queries: DataFrame) -> DataFrame:
    """At most ``SAMPLE`` queries, in the order of a hash of their ids."""
    order = F.md5(F.concat(F.lit("probe:"), F.col("query_id").cast("string")))
    return queries.orderBy(order, "query_id").limit(SAMPLE)


def build_cell_index(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    path: str | None = None,
    cells: int | None = None,
    probes: int | None = None,
    seed: int = 17,
    metric: str = "l2",
    recall: float = 0.92,
) -> CellIndex:
    """Store ``base`` by its nearest of ``cells`` hash-sampled points.

    Without ``cells`` there are as many as the square root of the row count.
    The shortlist is the least that holds nearly all of the ``k`` nearest
    neighbours of a sample of ``queries`` by code. Without ``probes`` they are
    the fewest that find the share ``recall`` of them, compared with brute force
    once: the rank of every true neighbour's code and cell tells all at a time.
    """
    spark = base.sparkSession
    path = path or table_path(spark, "cell-index")
    n = base.count()
    cells = max(2, cells or math.ceil(math.sqrt(n)))
    params = CarveParams(leader_frac=1.0, max_leaders=cells, seed=seed, metric=metric)
    root = digits(F.lit(0))
    groups = spark.range(1).select(root.alias("path"), F.lit(n).alias("n"))
    members = base.withColumn("path", root)
    centres, size = leaders_of_level(members.select("path", "vec_id"), base, groups, params)
    centres = centres.select("vec_id", "v")
    assigned = assign_to_leaders(members, centres.withColumns({"path": root, "child": F.lit(0).cast("bigint")}), metric, size)
    owned = assigned.select("vec_id", F.col("leader").alias("cell"))
    # A file per cell and some more for hot ones, not one per cell and task.
    largest = base.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    scale = float(largest or 1.0)
    stored = owned.join(base, "vec_id").select("cell", "vec_id", code_of("v", scale).alias("code"), "v")
    stored.repartition("cell").write.partitionBy("cell").option("maxRecordsPerFile", 1_000_000).parquet(f"{path}/members")
    centres.write.parquet(f"{path}/centres")
    schema = f"cell bigint, {_schema_of(base)}"
    stored = spark.read.schema(schema).parquet(f"{path}/members")

    sample = materialize(probe_sample(queries), "probe-sample")
    truth = topk_join(sample, base, k, metric).select("query_id", "vec_id")
    codes = stored.select("vec_id", F.col("code").alias("v"))
    by_code = topk_join(in_steps(sample, scale), codes, k * FACTORS[-1], metric)
    ranks = topk_join(sample, centres, cells, metric, base_bytes=size).select(
        "query_id", F.col("vec_id").alias("cell"), F.col("rank").alias("cell_rank")
    )
    met = truth.join(by_code.select("query_id", "vec_id", F.col("rank").alias("code_rank")), ["query_id", "vec_id"], "left")
    met = met.join(stored.select("vec_id", "cell"), "vec_id").join(ranks, ["query_id", "cell"])
    # The smallest factor per neighbour; at most a row per cell and factor comes to the driver.
    needed = F.ceil(F.col("code_rank") / k)
    factor = F.coalesce(*[F.when(needed <= f, F.lit(f)) for f in FACTORS], F.lit(0))
    counts = met.groupBy("cell_rank", factor.alias("factor")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell_rank").collect()
    total = sum(r["n"] for r in counts)
    held = lambda f: sum(r["n"] for r in counts if 0 < r["factor"] <= f)
    chosen = next((f for f in FACTORS if held(f) >= KEPT * total), FACTORS[-1])
    found = read = None
    if probes is None:
        sums, probes = 0, 1
        for row in counts:
            if 0 < row["factor"] <= chosen:
                if sums >= recall * total and row["cell_rank"] > probes:
                    break
                probes, sums = row["cell_rank"], sums + row["n"]
        found = sums / total if total else 1.0
        sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("_size"))
        probed = ranks.filter(F.col("cell_rank") <= probes).join(sizes, "cell", "left")
        share = probed.groupBy("query_id").agg(F.sum("_size").alias("_read")).agg(F.avg("_read")).first()[0]
        read = float(share or 0) / max(1, n)
    compared = min(1.0, chosen * k / max(1, n))
    row = (cells, probes, chosen * k, found, read, compared, n, scale, metric)
    about = spark.createDataFrame([row], _ABOUT)
    about.write.parquet(f"{path}/about")
    return CellIndex(path, about, centres, stored, probes, chosen * k, scale, metric)


def _schema_of(base: DataFrame) -> str:
    kind = base.schema["v"].dataType.elementType.simpleString()
    return _VECTOR.format(kind)


def open_cell_index(spark: SparkSession, path: str) -> CellIndex:
    """The index that was stored under ``path``."""
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about")
    centres = spark.read.parquet(f"{path}/centres")
    members = spark.read.schema(f"cell bigint, {_schema_of(centres)}").parquet(f"{path}/members")
    row = about.first()
    return CellIndex(
        path, about, centres, members, row["probes"], row["shortlist"], row["scale"], row["metric"]
    )


class _Probes:
    """The nearest cells of queries, told inside tasks from the centres: about the square root of the points."""

    column, asked = "cell", "_asked"

    def __init__(self, index: CellIndex, probes: int):
        self.probes, self.metric = probes, index.metric
        spark = index.centres.sparkSession
        self.centres = spark.sparkContext.broadcast(index.centres.select("vec_id", "v").toArrow())

    def lists(self, rows, name: str = asked):
        """Offsets and cells of the queries in a table."""
        ids = blocks.numbers(self.centres.value, "vec_id")
        row, at = blocks.nearest_sets(
            blocks.matrix(rows, name), blocks.matrix(self.centres.value, "v"), ids, self.probes, self.metric
        )
        return np.searchsorted(row, np.arange(len(rows) + 1)), ids[at]

    def cells(self, queries: DataFrame) -> DataFrame:
        """The cells that some query probes."""
        probing = self

        def probed(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, _TOGETHER):
                    cells = np.unique(probing.lists(batch.slice(start, _TOGETHER), "v")[1])
                    yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

        return queries.select("v").mapInArrow(probed, "cell bigint").distinct()


def probe_cells(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Top-k of every query among the points of its nearest cells: ``query_id, rank, vec_id, d``.

    The first pass reads ids and codes alone, of cells that some query probes, and keeps
    ``shortlist`` points per query; the second scores those by their vectors. A query meets the
    codes as in brute force, once per block of them, and the task tells which cells it
    probes: nothing is copied per probed cell, however many they are.
    """
    probes, keep = index.probes if probes is None else probes, max(k, index.shortlist)
    near = _Probes(index, probes)
    # Both are read several times below; ``likely`` meets all codes and is found once.
    probed = materialize(near.cells(queries), "probed-cells")
    codes = index.members.select("cell", "vec_id", F.col("code").alias("v"))
    codes = codes.join(F.broadcast(probed), "cell", "left_semi")
    # Rows that share an id probe the cells of each other.
    probing = queries.select("query_id", F.col("v").alias(near.asked))
    asked = sorted_join(probing, in_steps(queries, index.scale).select("query_id", "v"), "query_id")
    likely = topk_join(asked, codes, keep, index.metric, within=near).drop("rank")
    likely = top_per(likely, ["query_id"], ["d", "vec_id"], keep)
    pairs = materialize(likely.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst")), "likely")
    scored = score_edges(
        pairs, index.members.select("vec_id", "v"), index.metric,
        sources=queries.select(F.col("query_id").alias("vec_id"), "v"),
    )
    best = top_per(scored, ["src"], ["d", "dst"], k)
    return best.select(F.col("src").alias("query_id"), "rank", F.col("dst").alias("vec_id"), "d")


def approx_baseline(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    cells: int | None = None,
    probes: int | None = None,
    seed: int = 17,
    metric: str = "l2",
    recall: float = 0.92,
) -> DataFrame:
    """Build the index and probe it: ``query_id, rank, vec_id, d``; see ``build_cell_index``."""
    index = build_cell_index(base, queries, k, None, cells, probes, seed, metric, recall)
    return probe_cells(index, queries, k)
