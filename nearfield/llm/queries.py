"""The registered queries of the llm operators, with their production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearfield.llm import (
    bytepairs, fertility, importance, jaccard, manifest, maxent, mixing, packing, phrases, tokenids,
    toxicity, vectordups, warc,
)
from nearfield.runtime import ship_package, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int):
    """crc32 of the id as text, by ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query
def op1_token_ids(spark, sf_dir):
    path = table_path(spark, "token-ids")
    tokenids.write_lists(tokenids.encode_ids(table(spark, sf_dir, "documents"), WORD_BPE), path)
    return tokenids.with_crc(tokenids.read_ids(spark, path))


@query
def op2_warc(spark, sf_dir):
    path = table_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).drop("url")


@query
def op3_fertility(spark, sf_dir):
    return fertility.quality_rules(table(spark, sf_dir, "documents"), PIECE_BPE)


@query
def op4_range_graph(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return vectordups.near_duplicate_points(points)


@query
def op5_mixing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op6_maxent(spark, sf_dir):
    held_out = remainder(7) == 2
    scored = maxent.language_model(table(spark, sf_dir, "documents"), held_out)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query
def op7_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(documents, labels.filter(remainder(4) != 2))
    scored = toxicity.score_toxicity(documents, model)
    return scored.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


@query
def op8_importance(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sampled = importance.resample(documents.select("doc_id", "text"), labels)
    return sampled.drop("text")


@query
def op9_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "loss_tokens")


@query
def op10_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_byte_pairs(spark, sf_dir):
    coded = bytepairs.encode_texts(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = bytepairs.decode_ids(coded, BYTE_RANKS, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


@query
def op13_merkle_manifest(spark, sf_dir):
    fields = ("doc_id", "source", "lang", "n_chars")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    tampered = F.when(remainder(3) == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    leaves = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("lang").alias("part"),
        manifest.record_digest(*fields, "text").alias("leaf"),
        manifest.record_digest(*fields, tampered).alias("shown"),
    )
    proofs = manifest.merkle_proofs(leaves, keep=("shown",))
    proofs = proofs.withColumn("folded_root", manifest.fold_proof("shown"))
    return proofs.select(
        F.col("vec_id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op11_phrases(spark, sf_dir):
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))
