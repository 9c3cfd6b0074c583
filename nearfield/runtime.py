"""Session set-up, intermediate tables and skew-safe row numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# Session settings of this library, with their defaults.
BROADCAST_BYTES = ("spark.nearfield.broadcastBytes", 32 * 1024 * 1024)
BLOCK_BYTES = ("spark.nearfield.blockBytes", 32 * 1024 * 1024)
#: Overrides ``blockBytes`` where it is set to a positive number.
BLOCK_ROWS = ("spark.nearfield.blockRows", 0)
#: Blocks that a side is cut into at most, unless a block would exceed ``blockBytes``.
MOST_CUTS = 16
SLICE_ROWS = ("spark.nearfield.sliceRows", 1_000_000)


def setting(spark: SparkSession, entry: tuple[str, int]) -> int:
    name, default = entry
    return int(spark.conf.get(name, str(default)))


def block_rows(spark: SparkSession, dim: int) -> int:
    """Rows of vectors with ``dim`` doubles that make a block.

    A table of n rows is cut into n / block_rows blocks and each of its rows is
    copied once per block of the other side: a million rows of 64 dimensions
    against a million are 16 blocks a side, so 16 copies of every row.
    """
    rows = setting(spark, BLOCK_ROWS)
    return rows if rows > 0 else full_block_rows(spark, dim)


def block_count(spark: SparkSession, rows: int, dim: int) -> int:
    """Blocks of a table: small ones grow beyond ``MOST_CUTS`` of them, up to ``blockBytes``."""
    return max(min(-(-rows // block_rows(spark, dim)), MOST_CUTS), -(-rows // full_block_rows(spark, dim)))


def full_block_rows(spark: SparkSession, dim: int) -> int:
    """Rows that fill ``blockBytes``, whatever ``blockRows`` says."""
    return max(1024, setting(spark, BLOCK_BYTES) // (8 * max(1, dim)))


def session(app: str = "nearfield", master: str | None = None, **conf) -> SparkSession:
    """A session with the adaptive settings the plans count on, and this package on its executors."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package when it is not installed on them.

    Does the same as ``spark-submit --py-files``, once per application.
    """
    marker = "_nearfield_shipped"
    context = spark.sparkContext
    if getattr(context, marker, None) == context.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="nearfield-"), "nearfield.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    setattr(context, marker, context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="nearfield-tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return "/".join(
        [shared_folder(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}"]
    )


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder; returns its path."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true
    size of the table for its later join choices.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Number the rows of every group from 1 in the given order.

    Works for groups of any size: rows are range-partitioned on (group, order),
    numbered inside their partition, and shifted by the rows of the earlier
    partitions. ``order`` must be unique inside a group.
    """
    keys = group + order
    tagged = materialize(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "positions"
    )
    per_part = tagged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        *group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*group, "_part").orderBy(*order)
    inner = tagged.withColumn("_inside", F.row_number().over(inside))
    return (
        sorted_join(inner, offsets, group + ["_part"])
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_offset")
    )


def sorted_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input; neither is sent through the driver.

    Adaptive execution takes the size of a join or of collected lists for that
    of the first table below them, and broadcasts results of any size. Use a
    plain join with ``F.broadcast`` where a side is bounded.
    """
    return left.join(right.hint("merge"), keys, how)


def hot_key_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of a table with repeated keys to one row per key, hot keys sliced.

    A key with more than ``sliceRows`` rows is cut into slices by the hash of
    column ``spread`` and its single row is repeated once per slice, so no
    task receives more than about one slice of a key.
    """
    rows = setting(many.sparkSession, SLICE_ROWS)
    hot = (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows)
        .select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_slices"))
    )
    if hot.isEmpty():
        return sorted_join(many, one, keys)
    left = (
        many.join(hot, keys, "left")
        .withColumn("_slices", F.coalesce("_slices", F.lit(1)))
        .withColumn("_slice", F.pmod(F.xxhash64(spread), F.col("_slices")).cast("int"))
        .drop("_slices")
    )
    right = (
        one.join(hot, keys, "left")
        .withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
        )
        .drop("_slices")
    )
    return sorted_join(left, right, keys + ["_slice"]).drop("_slice")


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``keys``: joins on them do not shuffle it again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"nearfield_{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", table_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)
