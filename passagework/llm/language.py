"""Stupid-backoff language-model scores, computed as joins of n-gram counts with the n-grams of the documents.

The score of a word is the count of the longest n-gram ending at it divided by the count of its history; each step to a
shorter history costs the factor 0.4. N-grams of two words and more that occur fewer than ``least`` times are left out of the
tables, so their words back off; single words are always known, as the counts come from the scored documents.

One row per n-gram and document would move many times the corpus. So documents are packed into blocks, a block's distinct n-grams are
sent once, as sorted hashes, to the partition that owns the hash range; there all blocks' counts are summed and each block gets
back the total for every n-gram it sent, in its own order. The block's documents are then joined to those totals and summed per document.
Hashes have 56 bits: two n-grams of a corpus of 10^10 different ones share a hash with a chance below 2 in 10^7.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import blank_separated
from passagework.plans.stage import stage

ORDER, LEAST, BACKOFF = 3, 2, 0.4
#: Bytes of text in a block; words whose n-grams one range partition holds, on average.
BLOCK_BYTES, RANGE_WORDS = 8 << 20, 3_000_000
_REMEMBERED = 1 << 18
_BITS = 56
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: list[bytes | None], order: int, memory: dict[bytes, int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each length the hashes of the n-grams ending at each word, whether there are so many words; words per text."""
    words, lengths = array("Q"), np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        found = blank_separated(text)
        lengths[at] = len(found)
        for word in found:
            code = memory.get(word)
            if code is None:
                if len(memory) >= _REMEMBERED:
                    memory.clear()
                code = memory[word] = xxhash.xxh64_intdigest(word, 1)
            words.append(code)
    first = np.frombuffer(words, np.uint64) if words else np.zeros(0, np.uint64)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes, valid = [first], [np.ones(len(first), bool)]
    for n in range(2, order + 1):
        longer = np.zeros_like(first)
        if len(first) >= n:
            x = (hashes[-1][:-1] ^ np.uint64(n)) * _MIX  # of the n - 1 words that end before this one
            x = (x ^ (x >> np.uint64(31))) + first[1:] * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * _MIX
            longer[1:] = x ^ (x >> np.uint64(32))
        hashes.append(longer)
        valid.append(nth >= n - 1)
    return [h >> np.uint64(64 - _BITS) for h in hashes], valid, lengths


def _distinct(hashes: list[np.ndarray], valid: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([h[v] for h, v in zip(hashes, valid)]), return_counts=True)


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the high planes of small numbers vanish."""
    wide = np.ascontiguousarray(values, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _packed_texts(texts: list[bytes | None]) -> tuple[bytes, list[int]]:
    data = zstandard.ZstdCompressor(level=9).compress(b"".join(t or b"" for t in texts))
    return data, [len(t or b"") for t in texts]


def _texts(data: bytes, lengths: np.ndarray) -> list[bytes]:
    joined, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(lengths)
    return [joined[end - n:end] for end, n in zip(ends.tolist(), np.asarray(lengths).tolist())]


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """One row per block: block, ids, lengths and the compressed texts; a document larger than a block is its own."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0

        def row():
            data, lengths = _packed_texts(texts)
            return pd.DataFrame({"ids": [ids], "lengths": [lengths], "texts": [data], "words": [sum(len(blank_separated(t)) for t in texts)]})

        for batch in batches:
            for key, value in zip(batch["doc_id"], batch["text"]):
                if size and size + len(value or b"") > BLOCK_BYTES:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(None if pd.isna(key) else int(key))
                texts.append(value)
                size += len(value or b"")
        if ids:
            yield row()

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    packed = source.mapInPandas(gather, "ids array<bigint>, lengths array<bigint>, texts binary, words bigint")
    return stage(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def totals(blocks: DataFrame, ranges: int, order: int = ORDER) -> DataFrame:
    """``block, range, counts``: for every n-gram of a block, in order of its hash, how often all documents hold it."""
    step = (1 << _BITS) // ranges + 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for block, data, lengths in zip(batch["block"], batch["texts"], batch["lengths"]):
                hashes, valid, _ = _grams(_texts(data, lengths), order, memory)
                found, counts = _distinct(hashes, valid)
                cuts = np.searchsorted(found, [np.uint64(step * r) for r in range(1, ranges)]).tolist() if len(found) else []
                edges = [0, *cuts, len(found)] if len(found) else []
                for r, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        yield pd.DataFrame({"range": [r], "block": [block], "hashes": [pack(np.diff(found[a:b], prepend=np.uint64(0)))], "counts": [pack(counts[a:b])]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(unpack(h), dtype=np.uint64) for h in part["hashes"]]
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpack(c) for c in part["counts"]]).astype(float), len(names)).astype(np.uint64)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        return pd.DataFrame({"block": part["block"], "range": part["range"], "counts": [pack(sums[x]) for x in np.split(at, ends)]})

    sent = blocks.select("block", "texts", "lengths").mapInPandas(send, "range int, block bigint, hashes binary, counts binary")
    return sent.groupBy("range").applyInPandas(add, "block bigint, range int, counts binary")


def stupid_backoff(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, text: str = "text") -> DataFrame:
    """Per row of ``docs`` (repeated rows too): doc_id, n_words, log_score (sum of natural logarithms), mean_log_score.

    Words are the lower-cased runs between white space; documents do not run into each other. Null and blank texts have
    0 words, score 0 and a null mean; repeated documents count as often as they come; an empty table gives no rows. Counts
    are exact up to collisions of 56-bit hashes.
    """
    blocks = _blocks(docs, text)
    words = blocks.agg(F.sum("words")).first()[0] or 0
    ranges = max(8, -(-words // RANGE_WORDS))
    returned = totals(blocks, ranges, order).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "counts"))).alias("parts"))
    met = blocks.join(returned, "block", "left").select("ids", "texts", "lengths", F.col("parts.counts").alias("counts"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for ids, data, lengths, parts in zip(batch["ids"], batch["texts"], batch["lengths"], batch["counts"]):
                hashes, valid, n_words = _grams(_texts(data, lengths), order, memory)
                logs = np.zeros(len(hashes[0]))
                if len(logs):
                    found, _ = _distinct(hashes, valid)
                    sums = np.concatenate([unpack(p) for p in parts])
                    counts = [np.where(v, sums[np.minimum(np.searchsorted(found, h), len(found) - 1)], 0).astype(float) for h, v in zip(hashes, valid)]
                    logs = _logs(counts, words, least, backoff)
                doc = np.repeat(np.arange(len(ids)), n_words)
                total = np.bincount(doc, logs, len(ids))
                mean = [t / n if n else None for t, n in zip(total.tolist(), n_words.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(list(ids), dtype="Int64"), "n_words": n_words, "log_score": total, "mean_log_score": pd.Series(mean, dtype=object)})

    return met.mapInPandas(score, "doc_id bigint, n_words bigint, log_score double, mean_log_score double")


def _logs(counts: list[np.ndarray], words: int, least: int, backoff: float) -> np.ndarray:
    """Logarithm of the stupid-backoff score of each word; ``counts[n - 1]`` are those of the n-grams that end at it."""
    logs = np.log(counts[0] / words)
    for n in range(2, len(counts) + 1):
        history = np.append(1.0, counts[n - 2][:-1])  # of the n - 1 words before
        known = counts[n - 1] >= least
        with np.errstate(divide="ignore", invalid="ignore"):
            longer = np.log(counts[n - 1] / history)
        # a word with too short a history pays nothing for not having the longer n-gram
        logs = np.where(known, longer, logs + np.where(counts[n - 1] > 0, np.log(backoff), 0.0))
    return logs
