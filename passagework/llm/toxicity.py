"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled texts hold an unknown share (the class prior) of toxic ones. The linear
classifier on word presence is trained in numpy on the corrected risk
``prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])`` with the logistic loss ``l(z) = log(1 + exp(-z))``. Where
the bracket falls below zero the step goes against it, which keeps the fit from explaining the unlabelled texts away.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import terms
from passagework.plans.stage import stage

#: Most rows of either kind the classifier is fitted on (a seeded sample).
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: A word is weighed if so many positives hold it, it is so many times as frequent there as in unlabelled texts, and the
#: likelihood ratio of the two counts (G squared) is at least this; none of it depends on how many toxic words there are.
LEAST_COUNT, LEAST_RATIO, LEAST_G = 3, 2.0, 20.0


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) - (1 << 63)


def word_codes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the distinct words of a text, in order."""
    return np.array(sorted({word_code(word) for word in set(terms(text))}), np.int64)


def held_out(id_column: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    weights: dict[int, float]  #: by hash of the word
    bias: float

    def margin(self, text: bytes | None) -> float:
        """Bias plus the weights of a text's distinct words; the same sum whatever order a set has."""
        codes = {word_code(word) for word in set(terms(text))}
        return self.bias + sum(self.weights[code] for code in sorted(codes.intersection(self.weights)))


def nothing(prior: float) -> Model:
    """A model without words: every score is the prior."""
    return Model({}, float(np.log(prior / (1 - prior))))


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, features: int, prior: float, steps: int = 800,
             rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; ``rows, cols`` are the set entries of the 0/1 feature matrix."""
    n = len(positive)
    pos, unl = positive.astype(float), (~positive).astype(float)
    pos, unl = pos / max(pos.sum(), 1), unl / max(unl.sum(), 1)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = w[-1] + np.bincount(rows, w[cols], n)
        up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # slope of l(-g); that of l(g) is up - 1
        as_negative = unl - prior * pos
        bracket = float(as_negative @ np.logaddexp(0, g))
        slope = prior * pos * (up - 1) + as_negative * up if bracket >= 0 else -as_negative * up
        grad = np.append(np.bincount(cols, slope[rows], features), slope.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the rows that are not held out; ``labels`` has doc_id and toxic.

    Positives are texts labelled toxic; the unlabelled side is a sample of all training texts, whose labels are not looked
    at. Either side is the first ``fit_rows`` in a seeded hash order of the id, which also bounds the words that can be weighed. ``prior`` is the share of toxic texts; by
    default that of the training labels, but no more than the unlabelled texts allow: for any set of texts the prior is at
    most its share among them over its share among the positives, here taken of the texts with a word that is four times as
    frequent among the positives. A label without a text, or null, is not used; an id labelled twice counts as toxic if one
    label says so. Without any positive text every score is the prior, 0.02 at least.
    """
    known = labels.where(~held_out()).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.sum(F.col("toxic").cast("bigint"))).first()
    prior = min(0.9, max(0.02, prior if prior is not None else (counts[1] or 0) / max(counts[0], 1)))
    pool = docs.where(~held_out()).select("doc_id", F.col("text").cast("binary").alias("text"))
    toxic = known.where("toxic = 1").select("doc_id")
    sample = [
        kind.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(fit_rows)
        for kind in (toxic, pool.select("doc_id"))
    ]
    chosen = sample[0].withColumn("positive", F.lit(True)).unionByName(sample[1].withColumn("positive", F.lit(False)))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "codes": [word_codes(t) for t in batch["text"]]})

    fitted = pool.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInPandas(seen, "positive boolean, codes array<bigint>")
    fitted = stage(fitted, "fit").withColumn("row", F.monotonically_increasing_id())
    sides = {r[0]: r[1] for r in fitted.groupBy("positive").count().collect()}
    if not sides.get(True):
        return nothing(prior)
    n_p, n_u = sides[True], sides.get(False, 0)
    holds = fitted.select("positive", F.explode("codes").alias("code")).groupBy("code").agg(
        F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")
    ).where(F.col("p") >= LEAST_COUNT)
    both = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    of_u = F.when(F.col("u") > 0, F.col("u") * F.log(F.col("share_u") / both)).otherwise(0.0)
    holds = holds.withColumns({"share_p": F.col("p") / F.lit(n_p), "share_u": F.col("u") / F.lit(max(n_u, 1))})
    holds = holds.withColumn("g", 2 * (F.col("p") * F.log(F.col("share_p") / both) + of_u))
    holds = holds.where((F.col("share_p") >= LEAST_RATIO * F.col("share_u")) & (F.col("g") >= LEAST_G)).toPandas()
    if not len(holds):
        return nothing(prior)
    picked = np.sort(holds["code"].to_numpy())
    kept = F.array_intersect("codes", F.lit(picked.tolist()))
    data = fitted.select("positive", kept.alias("codes")).toPandas()
    lengths = [len(x) for x in data["codes"]]
    positive = data["positive"].to_numpy(bool)
    strong = np.sort(holds["code"][holds["share_p"] >= 4 * holds["share_u"]].to_numpy())
    marked = np.array([len(np.intersect1d(x, strong, assume_unique=True)) > 0 for x in data["codes"]])
    if marked[positive].mean() > 0.05 and (~positive).any():
        prior = min(prior, max(0.02, marked[~positive].mean() / marked[positive].mean()))
    cols = np.searchsorted(picked, np.concatenate([np.asarray(x, np.int64) for x in data["codes"]]))
    w, bias = fit_nnpu(np.repeat(np.arange(len(data)), lengths), cols, positive, len(picked), prior)
    return Model(dict(zip(picked.tolist(), w.tolist())), bias)


def with_score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being toxic; null and empty texts get that of a text without weighed words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            margins = np.array([shared.value.margin(t) for t in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margins, -40, 40))))

    return docs.withColumn(name, score(F.col(text).cast("binary")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (repeated rows too): doc_id, held_out, score, predicted (1 at ``threshold`` or more)."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their own columns."""
    return with_score(docs, train(docs, labels), "toxicity score").where(F.col("toxicity score") < threshold).drop("toxicity score")
