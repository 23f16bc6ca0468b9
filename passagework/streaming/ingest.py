"""Incremental, replay-safe form of the ingest job: files that arrive become rows of the three stored tables once."""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.functions.text import file_extension
from passagework.operators.ingest import ingest_found
from passagework.plans.stage import stage
from passagework.sources.files import SUPPORTED_SUFFIXES, Handler

#: Columns of Spark's reader of whole files.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUPPORTED_SUFFIXES) -> DataFrame:
    """Streaming (uri, arrived, content) of the supported files below ``folder``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    wanted = files.filter(F.concat(F.lit("."), file_extension(F.col("path"))).isin(*suffixes))
    return wanted.select(F.col("path").alias("uri"), F.col("modificationTime").alias("arrived"), "content")


def stream_ingest(
    source: DataFrame, path: str, checkpoint: str, handlers: list[Handler], run_params: DataFrame, provider_factory: Callable, dim: int,
    model: str, types: dict[str, str], now: Column,
) -> StreamingQuery:
    """Start the job over a streaming DataFrame (uri, arrived, content BINARY); it stops once everything present has been taken in.

    Each micro-batch is one batch of :func:`passagework.operators.ingest.ingest_found`, with metadata, timestamps and config rows.
    Of several contents of one uri in a micro-batch the one that arrived last counts, the larger hash on ties. A replayed batch
    replaces its own unfinished attempt and leaves a finished one alone.
    """
    # Batch numbers restart with every checkpoint, so the checkpoint is part of a batch's name.
    job = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(rows: DataFrame, batch_id: int) -> None:
        once = stage(rows, "arrived")
        if not once.groupBy("uri").count().filter("count > 1").isEmpty():  # only then contents are brought together by uri
            last = F.max_by("content", F.struct("arrived", F.sha2("content", 256))).alias("content")
            once = stage(once.groupBy("uri").agg(last), "latest")
        ingest_found(once.select("uri", "content"), path, f"{job}-{batch_id}", handlers, run_params, provider_factory, dim, model, types, now)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
