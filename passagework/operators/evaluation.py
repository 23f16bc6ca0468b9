"""Evaluation of retrieval and answers over verdict tables.

The scores are our own definitions from standard retrieval measures. Verdicts may come from any judge; the built-in one is
lexical: a reference sentence is supported (a context is relevant) when at least ``theta`` of its (of the reference's)
distinct words occur in one context. Words are runs of letters and digits of any script; A-Z are lower-cased.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.operators.chunking import SENTENCES_AND_LINES

DEFAULT_THETA = 0.6
DEFAULT_FACT_WEIGHT = 0.75


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def eval_table(samples: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """(sample_id, user_input, reference, retrieved_contexts, response) with contexts in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content")))
    contexts = results.groupBy("sample_id").agg(F.transform(ranked, lambda r: r["content"]).alias("retrieved_contexts"))
    out = samples.join(contexts, "sample_id", "left").join(answers.select("sample_id", "answer"), "sample_id", "left")
    return out.select(
        "sample_id", "user_input", "reference",
        F.coalesce("retrieved_contexts", F.array().cast("array<string>")).alias("retrieved_contexts"),
        F.coalesce("answer", F.lit("")).alias("response"),
    )


def _context_words(results: DataFrame) -> DataFrame:
    return results.select("sample_id", "rank", F.explode(word_set(F.col("content"))).alias("word"))


def reference_sentences(samples: DataFrame) -> DataFrame:
    """(sample_id, sentence_no, sentence, words) of the reference sentences that have a word."""
    sentences = F.regexp_extract_all(F.col("reference"), F.lit(SENTENCES_AND_LINES), F.lit(0))
    rows = samples.select("sample_id", F.posexplode(sentences).alias("sentence_no", "sentence"))
    return rows.withColumn("words", word_set(F.col("sentence"))).filter(F.size("words") > 0)


def support_verdicts(samples: DataFrame, results: DataFrame, theta: float = DEFAULT_THETA) -> DataFrame:
    """(sample_id, sentence_no, supported) for every reference sentence that has a word.

    Sentences meet contexts through shared words of the same sample, so a word meets at most top_k contexts.
    """
    words = reference_sentences(samples).drop("sentence")
    single = words.select("sample_id", "sentence_no", F.size("words").alias("size"), F.explode("words").alias("word"))
    shared = single.join(_context_words(results), ["sample_id", "word"]).groupBy(
        "sample_id", "sentence_no", "rank", "size"
    ).agg(F.count(F.lit(1)).alias("n"))
    hits = shared.groupBy("sample_id", "sentence_no").agg(
        F.max((F.col("n") >= F.lit(theta) * F.col("size")).cast("int")).alias("supported")
    )
    every = words.select("sample_id", "sentence_no")
    return every.join(hits, ["sample_id", "sentence_no"], "left").withColumn("supported", F.coalesce("supported", F.lit(0)))


def relevance_verdicts(samples: DataFrame, results: DataFrame, theta: float = DEFAULT_THETA) -> DataFrame:
    """(sample_id, rank, relevant) for every retrieved context."""
    words = samples.select("sample_id", word_set(F.col("reference")).alias("words"))
    single = words.select("sample_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    shared = single.join(_context_words(results), ["sample_id", "word"]).groupBy("sample_id", "rank", "size").agg(
        F.count(F.lit(1)).alias("n")
    )
    hits = shared.select("sample_id", "rank", (F.col("n") >= F.lit(theta) * F.col("size")).cast("int").alias("relevant"))
    every = results.select("sample_id", "rank")
    return every.join(hits, ["sample_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def _of_samples(scores: DataFrame, samples: DataFrame | None) -> DataFrame:
    """``scores`` with a row of 0 for each of ``samples`` that has none."""
    if samples is None:
        return scores
    name = scores.columns[-1]
    return samples.select("sample_id").join(scores, "sample_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def context_recall(verdicts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, context_recall): share of the reference sentences some context supports.

    With ``samples`` every sample has a row; a reference without a word supports nothing and scores 0.
    """
    return _of_samples(verdicts.groupBy("sample_id").agg(F.avg("supported").alias("context_recall")), samples)


def context_precision(verdicts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, context_precision): average precision over the ranked contexts, 0 when none is relevant.

    With ``samples`` every sample has a row, 0 where nothing was retrieved.
    """
    so_far = Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.withColumn("precision", F.sum("relevant").over(so_far) / F.col("rank"))
    mean = F.try_divide(F.sum(F.col("precision") * F.col("relevant")), F.sum("relevant"))
    return _of_samples(at.groupBy("sample_id").agg(F.coalesce(mean, F.lit(0.0)).alias("context_precision")), samples)


def fact_counts(samples: DataFrame) -> DataFrame:
    """(sample_id, tp, fp, fn) of the word sets of ``response`` against ``reference``; row-local, no shuffle."""
    said, true = word_set(F.col("response")), word_set(F.col("reference"))
    both = F.size(F.array_intersect(said, true))
    return samples.select(
        "sample_id", both.alias("tp"), (F.size(said) - both).alias("fp"), (F.size(true) - both).alias("fn")
    )


def answer_correctness(facts: DataFrame, similarity: DataFrame, weight: float = DEFAULT_FACT_WEIGHT) -> DataFrame:
    """(sample_id, answer_correctness): weight * F1 of the facts + (1 - weight) * similarity (sample_id, similarity)."""
    f1 = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + (F.col("fp") + F.col("fn")) / 2), F.lit(0.0))
    joined = facts.join(similarity, "sample_id", "left")
    score = F.lit(weight) * f1 + F.lit(1 - weight) * F.coalesce("similarity", F.lit(0.0))
    return joined.select("sample_id", score.alias("answer_correctness"))


def eval_report(samples: DataFrame, recall: DataFrame, precision: DataFrame, correctness: DataFrame) -> DataFrame:
    """Scores per question plus one row of means (null sample_id); no rows at all for an empty set.

    A sample lacking a score stops the job: an average must not skip it silently. Rows and means are grouping sets of one
    joined table, so no score is computed twice.
    """
    out = samples.select("sample_id", "user_input")
    names = []
    for scores in (recall, precision, correctness):
        name = scores.columns[-1]
        out = out.join(scores, "sample_id", "left")
        failure = F.raise_error(F.concat(F.lit(f"no {name} for sample "), F.col("sample_id").cast("string")))
        out = out.withColumn(name, F.coalesce(F.col(name), failure.cast("double")))
        names.append(name)
    each = [F.col("sample_id"), F.col("user_input")]
    return out.groupingSets([each, []], *each).agg(*[F.avg(n).alias(n) for n in names]).select("sample_id", "user_input", *names)
