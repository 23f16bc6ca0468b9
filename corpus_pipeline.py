"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, source weights, shards, each stage on what the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import copies, decontamination, mixing, sharding, toxicity
from passagework.plans.stage import stage
from passagework.session import ship_package


#: Texts are long, so few rows go to a Python worker at once.
ARROW_ROWS = 1000


def _prepared(spark: SparkSession) -> SparkSession:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(ARROW_ROWS, int(spark.conf.get(key)) if int(spark.conf.get(key)) > 0 else ARROW_ROWS)))
    return ship_package(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 0.8 of their 5-word shingles: SimHash fingerprints and MinHash bands bring texts together, an exact check follows."""
    _prepared(spark)
    return copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken twice comes as two rows; one not taken goes."""
    return mixing.repeat_rows(docs, F.array("source"), mixing.word_count("text"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sharded corpus: each row with its texts and own columns, its size, checksum, shard and slot.

    Columns of the input that are named like one of those come as fields of a struct ``given``; it is there only if needed.
    """
    placed = sharding.shard_documents(docs, keep=tuple(docs.columns))
    own = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "given"]
    clash = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() in own]
    given = [F.struct(*clash).alias("given")] if clash else []
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in own], *own[:-1], *given)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained classifier, hashed fingerprints and seeded selection have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; the rows between two stages are a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
