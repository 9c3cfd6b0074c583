"""Point sets from Parquet tables, row limits and synthetic vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.functions.vectors import checked_vector, gaussian


def read_points(
    spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding",
    dim: int | None = None,
) -> DataFrame:
    """A Parquet table as points ``vec_id, v``; ``dim`` adds a length check."""
    vector = F.col(vector_col) if dim is None else checked_vector(vector_col, dim)
    return spark.read.parquet(path).select(
        F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("v")
    )


def as_queries(points: DataFrame) -> DataFrame:
    return points.select(F.col("vec_id").alias("query_id"), "v")


def first_rows(points: DataFrame, max_rows: int, id_col: str = "vec_id") -> DataFrame:
    """The rows with position below ``max_rows``; 0 keeps all.

    A filter rather than a limit: it reaches the scan and needs no single task.
    """
    return points.filter(F.col(id_col) < max_rows) if max_rows > 0 else points


def synthetic_vectors(ids: DataFrame, dim: int, seed: int) -> DataFrame:
    """Standard normal vectors for every ``vec_id``, whatever the partitioning."""
    key = lambda axis: F.concat_ws(":", F.lit(str(seed)), F.col("vec_id"), axis)
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda axis: gaussian(key(axis)))
    return ids.select("vec_id", values.alias("v"))


def synthetic_points(spark: SparkSession, n: int = 2000, dim: int = 32, seed: int = 42) -> DataFrame:
    return synthetic_vectors(spark.range(n).withColumnRenamed("id", "vec_id"), dim, seed)
