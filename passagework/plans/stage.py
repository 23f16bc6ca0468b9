"""Cutting lineage through a table in the shared folder, which outlives lost executors."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.session import scratch_path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back, so that several consumers do not recompute it."""
    return stage_at(df, scratch_path(df.sparkSession, name))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """:func:`stage` at a known place, for a table that is removed (:func:`remove`) once nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all its files, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
