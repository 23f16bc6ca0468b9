"""Verdicts of an injected judge over (statement, context) pairs, asked for once per content.

A judge maps a list of pairs to (index, verdict) pairs in any order, 1 for supported and 0 for not; it may leave some out.
What it leaves out is asked for again, a bounded number of times; a pair without a verdict then stops the job. Verdicts are
kept in a committed table by (judge, digest of the pair), so equal pairs of any sample or run are judged once.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.evaluation import reference_sentences
from passagework.plans.stage import stage
from passagework.sources.tables import commit_batch, read_committed

Judge = Callable[[list[tuple[str, str]]], list[tuple[int, int]]]
VERDICTS = "judge STRING, digest STRING, verdict INT"


@dataclass(frozen=True)
class Judging:
    """A judge (built once per task by ``factory``), the name its verdicts are kept under, and where."""

    factory: Callable[[], Judge]
    name: str
    path: str
    size: int = 128
    attempts: int = 3


def ask(judge: Judge, pairs: list[tuple[str, str]], attempts: int) -> list[int]:
    """One verdict per pair; pairs without an answer are asked for up to ``attempts`` times."""
    found: dict[int, int] = {}
    for _ in range(attempts):
        left = [i for i in range(len(pairs)) if i not in found]
        if not left:
            break
        for index, verdict in judge([pairs[i] for i in left]):
            if not 0 <= index < len(left) or verdict not in (0, 1):
                raise ValueError("a judge answers with the index of a pair and 0 or 1")
            found[left[index]] = int(verdict)
    if len(found) < len(pairs):
        raise ValueError(f"the judge gave no verdict on {len(pairs) - len(found)} pairs after {attempts} attempts")
    return [found[i] for i in range(len(pairs))]


def verdicts(pairs: DataFrame, judging: Judging, batch: str) -> DataFrame:
    """``pairs`` (statement, context and others) with ``verdict``; nulls read as empty. New verdicts are committed as ``batch``."""
    spark = pairs.sparkSession
    statement, context = (F.coalesce(c, F.lit("")) for c in ("statement", "context"))
    # the length keeps (ab, c) apart from (a, bc)
    keyed = pairs.withColumn("__pair", F.sha2(F.concat_ws("|", F.length(statement), statement, context), 256))
    known = read_committed(spark, judging.path, "verdicts", VERDICTS).filter(F.col("judge") == judging.name)
    texts = keyed.groupBy("__pair").agg(F.first(F.struct(statement.alias("statement"), context.alias("context"))).alias("p"))
    new = texts.join(known.select(F.col("digest").alias("__pair")), "__pair", "left_anti").select("__pair", "p.*")

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = judging.factory()
        for frame in frames:
            rows = list(zip(frame["statement"], frame["context"]))
            found = [v for at in range(0, len(rows), judging.size) for v in ask(judge, rows[at:at + judging.size], judging.attempts)]
            yield pd.DataFrame({"digest": frame["__pair"], "verdict": pd.Series(found, dtype="int32")})

    made = stage(new.mapInPandas(judged, "digest string, verdict int"), "verdicts")
    commit_batch(judging.path, {"verdicts": made.select(F.lit(judging.name).alias("judge"), "digest", "verdict")}, batch, {"verdicts": ["judge"]})
    every = known.select("digest", "verdict").unionByName(made).groupBy(F.col("digest").alias("__known")).agg(F.min("verdict").alias("__verdict"))
    joined = keyed.join(every, F.col("__pair") == F.col("__known"))
    return joined.select(*pairs.columns, F.col("__verdict").alias("verdict"))


def support_verdicts(samples: DataFrame, results: DataFrame, judging: Judging, batch: str) -> DataFrame:
    """(sample_id, sentence_no, supported): whether any context of the sample supports the sentence; top_k pairs a sentence."""
    sentences = reference_sentences(samples)
    contexts = results.select("sample_id", F.col("content").alias("context"))
    pairs = sentences.select("sample_id", "sentence_no", F.col("sentence").alias("statement")).join(contexts, "sample_id")
    hits = verdicts(pairs, judging, batch).groupBy("sample_id", "sentence_no").agg(F.max("verdict").alias("supported"))
    every = sentences.select("sample_id", "sentence_no")
    return every.join(hits, ["sample_id", "sentence_no"], "left").withColumn("supported", F.coalesce("supported", F.lit(0)))


def relevance_verdicts(samples: DataFrame, results: DataFrame, judging: Judging, batch: str) -> DataFrame:
    """(sample_id, rank, relevant): the verdict on the sample's reference in each retrieved context."""
    pairs = results.select("sample_id", "rank", F.col("content").alias("context")).join(
        samples.select("sample_id", F.col("reference").alias("statement")), "sample_id"
    )
    return verdicts(pairs, judging, batch).select("sample_id", "rank", F.col("verdict").alias("relevant"))
