"""Embedding chunks through an injected provider, and checks on the vectors."""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.tokens import bpe_counter
from passagework.plans.checks import first_reason, split_on_reason

# Fixed value: the most inputs one embedding request may hold.
MAX_INPUTS_PER_REQUEST = 2048

# A provider maps a list of texts to (index, vector) pairs in any order, one per text.
Provider = Callable[[list[str]], list[tuple[int, list[float]]]]


def check_batch_size(size: int) -> int:
    if not 1 <= size <= MAX_INPUTS_PER_REQUEST:
        raise ValueError(f"one request takes 1 to {MAX_INPUTS_PER_REQUEST} texts; {size} were asked for")
    return size


def assign_batches(chunks: DataFrame, size: int = MAX_INPUTS_PER_REQUEST) -> DataFrame:
    """Adds ``batch_no`` and ``batch_pos`` within each document; chunk order is kept."""
    n = F.lit(check_batch_size(size))
    return chunks.withColumn("batch_no", F.floor(F.col("chunk_index") / n).cast("int")).withColumn(
        "batch_pos", (F.col("chunk_index") % n).cast("int")
    )


def _answers(provider: Provider, texts: list[str]) -> list[np.ndarray]:
    """The vectors of one request, placed by the index that comes with each; a missing or foreign index is an error."""
    pairs = provider(texts)
    found = dict(pairs)
    if len(pairs) != len(texts) or found.keys() != set(range(len(texts))):
        raise ValueError("the provider must return one vector per input")
    return [np.asarray(found[i], dtype=np.float32) for i in range(len(texts))]


def embed_chunks(
    chunks: DataFrame,
    provider_factory: Callable[[], Provider],
    model: str,
    size: int = MAX_INPUTS_PER_REQUEST,
    text: str = "text",
) -> DataFrame:
    """Adds ``embedding`` and ``embedding_model``: one vector per row, aligned by the index the provider returns.

    The factory runs once per task, so clients and models are built on the executors.
    """
    check_batch_size(size)
    schema = T.StructType(
        [
            *chunks.schema.fields,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("embedding_model", T.StringType()),
        ]
    )

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        for pdf in frames:
            for low in range(0, len(pdf), size):  # a request at a time, so that no task holds the vectors of a whole batch
                part = pdf.iloc[low : low + size]
                yield part.assign(embedding=_answers(provider, part[text].tolist()), embedding_model=model)

    return chunks.mapInPandas(embed, schema)


# -- built-in provider: signed feature hashing of words (runs of letters and digits; A-Z are lower-cased) ------------

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Words that a worker remembers; characters of the texts whose words it holds at once.
_CACHE_LIMIT = 1 << 17
_SLICE_CHARS = 1 << 20


def _hash_word(word: str) -> tuple[int, int]:
    digest = hashlib.md5(word.encode().lower()).hexdigest()  # lower() of bytes folds A-Z only
    return int(digest[:8], 16), 1 if digest[8] < "8" else -1


class _WordHashes(dict):
    """Signed hash codes (code + 1 times the sign) of words, remembered per worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        code, sign = _hash_word(word)
        self[word] = signed = (code + 1) * sign
        return signed

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and sign of every word of a batch of texts; a null text has no words."""
        found = [WORD.findall(t or "") for t in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        signed = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(lengths.sum()))
        return np.repeat(np.arange(len(found)), lengths), np.abs(signed) - 1, np.sign(signed)


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about ``_SLICE_CHARS`` characters, of one text at least."""
    low = held = 0
    for at, t in enumerate(texts):
        if at > low and held + len(t or "") > _SLICE_CHARS:
            yield slice(low, at)
            low, held = at, 0
        held += len(t or "")
    if len(texts) > low:
        yield slice(low, len(texts))


def hashing_provider(dim: int) -> Callable[[], Provider]:
    """Factory of a provider that needs no model: each word adds its sign to the dimension its hash selects."""

    def factory() -> Provider:
        hashes = _WordHashes()

        def provide(texts: list[str]) -> list[tuple[int, list[float]]]:
            sums = np.empty((len(texts), dim), np.float32)  # whole numbers below 2 ** 24, so exact
            for part in _slices(texts):
                rows, codes, signs = hashes.codes(texts[part])
                sums[part] = np.bincount(rows * dim + codes % dim, weights=signs, minlength=(part.stop - part.start) * dim).reshape(-1, dim)
            return list(enumerate(sums))

        return provide

    return factory


def hashed_counts(rows: DataFrame, text: str, dim: int) -> DataFrame:
    """Adds parallel arrays ``bucket``/``weight``: the non-zero entries of the hashed vector, for large ``dim``."""
    schema = T.StructType(
        [
            T.StructField("bucket", T.ArrayType(T.LongType())),
            T.StructField("weight", T.ArrayType(T.LongType())),
        ]
    )

    @F.pandas_udf(schema)
    def sparse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for texts in batches:
            texts, both = texts.tolist(), {"bucket": [], "weight": []}
            for part in _slices(texts):
                rows, codes, signs = hashes.codes(texts[part])
                cells, place = np.unique(rows * dim + codes % dim, return_inverse=True)
                weight = np.bincount(place, weights=signs, minlength=len(cells)).astype(np.int64)
                cells, weight = cells[weight != 0], weight[weight != 0]
                ends = np.searchsorted(cells, np.arange(1, part.stop - part.start) * dim)
                both["bucket"] += np.split(cells % dim, ends)
                both["weight"] += np.split(weight, ends)
            yield pd.DataFrame(both)

    return rows.withColumn("__s", sparse(F.col(text))).select("*", "__s.bucket", "__s.weight").drop("__s")


# -- checks and views -------------------------------------------------------------------------------------------------


def check_vectors(rows: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows whose vector is present, of width ``dim`` and without null elements, the others with a reason)."""
    v = F.col(column)
    reason = first_reason(
        (v.isNull(), "vector is null"),
        (F.size(v) != dim, "vector has another width"),
        (F.exists(v, lambda x: x.isNull()), "vector has a null element"),
    )
    return split_on_reason(rows, reason)


def embedding_preview(rows: DataFrame, text: str = "text", column: str = "embedding") -> DataFrame:
    """Adds ``preview`` (60 code points, newlines as blanks), ``dim`` and the first two components."""
    v = F.col(column)
    return rows.withColumns(
        {
            "preview": F.translate(F.substring(text, 1, 60), "\n", " "),
            "dim": F.size(v),
            "first_component": F.round(F.try_element_at(v, F.lit(1)).cast("double"), 4),
            "second_component": F.round(F.try_element_at(v, F.lit(2)).cast("double"), 4),
        }
    )


# -- token counts -----------------------------------------------------------------------------------------------------


def bpe_token_counts(rows: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Sets ``token_count`` to the byte-level BPE count. The vocabulary file is loaded once per worker."""
    count = bpe_counter(vocabulary)
    return rows.withColumn("token_count", count(F.col(text)))


def token_counts(rows: DataFrame, tokenizer: str = "character", text: str = "text") -> DataFrame:
    if tokenizer == "character":
        return rows.withColumn("token_count", F.length(text))
    if tokenizer == "gpt2":
        return bpe_token_counts(rows, text)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")
