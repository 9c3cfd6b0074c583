"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.llm import fertility, importance, jaccard, mixing, packing
from nearfield.llm.queries import PIECE_BPE, WORD_BPE
from nearfield.runtime import materialize, ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(docs, labels).filter("kept").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words, few repeats and a fertility within their language's band."""
    ship_package(spark)
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "lang"))
    return fertility.quality_rules(docs, PIECE_BPE, keep=keep).filter("kept").select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Of rows that share an id one stays; rows without an id cannot be told apart
    and stay as they are.
    """
    ship_package(spark)
    classes = jaccard.near_duplicates(docs)
    firsts = classes.filter("doc_id = component_id").select("doc_id")
    chosen = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target of its source asks for."""
    ship_package(spark)
    return mixing.mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    pieces = packing.pack(docs, WORD_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "loss_tokens")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources", mix),
    ("packing", pack),
]

#: Hashed models, tokenisers and components have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
