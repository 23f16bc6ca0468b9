"""Evaluation sets: JSON lists of question/reference samples."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.plans.checks import split_on_reason

# The keys every sample must hold.
REQUIRED_KEYS = ("user_input", "reference")


class BadSamples(ValueError):
    """Raised for samples without the required keys."""


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples with both keys, what is refused with a reason). A null value counts as held.

    Refused are samples that lack a key, with the keys they hold, and files that are not a JSON list of objects.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "array<map<string,string>>")
    unread = F.array(F.lit(None).cast("map<string,string>"))
    samples = text.select(F.explode(F.coalesce(parsed, unread)).alias("sample"))
    lacking = [~F.map_contains_key("sample", key) for key in REQUIRED_KEYS]
    keys = F.array_join(F.array_sort(F.map_keys("sample")), ",")
    reason = F.when(F.col("sample").isNull(), "not a JSON list of objects").when(
        lacking[0] | lacking[1], F.concat(F.lit("sample has keys: "), keys)
    )
    good, bad = split_on_reason(samples, reason)
    return good.select(*[F.col("sample")[k].alias(k) for k in REQUIRED_KEYS]), bad.select("reason")


def load_eval_set(spark: SparkSession, path: str) -> DataFrame:
    good, bad = read_samples(spark, path)
    first = bad.first()
    if first is not None:
        raise BadSamples(f"evaluation set refused: {first['reason']}; {' and '.join(REQUIRED_KEYS)} are required")
    return good
