"""Run metrics as JSON and sweep summaries as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

METRICS_SCHEMA = "mode string, build_sec double, recall_at_10 double, qps double, edges bigint"
SUMMARY = ["name", "mode", "build_sec", "recall_at_10", "qps", "edges"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON objects; missing folders are created."""
    metrics.select("mode", "build_sec", "recall_at_10", "qps", "edges").write.mode(
        "overwrite"
    ).json(path)


def read_metrics(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", "false").json(path)


def write_summary(runs: DataFrame, path: str) -> None:
    """Named runs as one table with a header, values with six decimals."""
    six = [F.format_string("%.6f", c).alias(c) for c in ("build_sec", "recall_at_10", "qps")]
    runs.select("name", "mode", *six, "edges").write.mode("overwrite").csv(
        path, sep="\t", header=True
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, " + METRICS_SCHEMA
    return spark.read.schema(schema).csv(path, sep="\t", header=True)
