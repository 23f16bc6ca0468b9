"""Registered queries: each operator over its whole table with production parameters."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import decontamination, dialogue, divergence, extraction, hosts, language, licenses, mixing, packing, pq, sharding, simhash, sql, toxicity
from passagework.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(ship_package(spark), folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query("op1_host_trust", sql.OP1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return hosts.url_verdicts(load(spark, folder, "pages"))


@query("op2_embedding_pq", sql.OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pq.near_embeddings(load(spark, folder, "embeddings"))


@query("op3_stupid_backoff", sql.OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Sums are rounded to 6 decimals: engines differ in the last bits of a sum."""
    scored = language.stupid_backoff(load(spark, folder, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")])


@query("op4_decontamination", sql.OP4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "benchmark"))
    return found.drop("spans")


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text", "source")
    taken = mixing.mix(docs, F.array("source"), mixing.word_count("text"))
    return taken.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op6_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(load(spark, folder, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(load(spark, folder, "documents"), load(spark, folder, "labels"))


@query("op9_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extracted_pages(load(spark, folder, "pages"))


@query("op10_licenses")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return licenses.license_scan(load(spark, folder, "documents"), path)


@query("op11_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(load(spark, folder, "documents").select("doc_id", "text"), vocabulary)


@query("op12_dialogue_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repaired(dialogue.damaged(load(spark, folder, "conversations")))


@query("op13_source_divergence", sql.OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(load(spark, folder, "documents"))
