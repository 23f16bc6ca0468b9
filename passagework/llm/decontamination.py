"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of ``width`` item words (a shorter item is one window). It occurs in a document only if its rarest word
does, so that one word is the prefix to join on. Words are ranked by the number of documents that hold them, counted over
the whole corpus. A document word equal to a prefix gives candidates at the offsets which the windows have for it; a
candidate that would begin before the first word or end after the last is dropped (position and length bounds), and the rest
are compared word for word.

The windows are the small side. Their size is counted first and they go out in blocks of at most ``block_bytes``; each block
is one pass over the documents, so a benchmark of any size is joined whole with bounded memory.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import terms
from passagework.plans.stage import stage

WIDTH = 10
#: Bytes of window text and ids in one broadcast block.
BLOCK_BYTES = 32 << 20
#: Bytes of a text that are cut into words at once.
PART_BYTES = 4 << 20


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, window``: distinct windows of every item, words joined by one blank; an item without words has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = terms(text)
                rows += [(item, w) for w in {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1) if words else 0)}]
            yield pd.DataFrame(rows, columns=["item_id", "window"])

    source = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInPandas(cut, "item_id string, window binary").distinct()


def _parts(text: bytes | None, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """Pieces of a long text: number of the first word and the words, each piece beginning with the last ones before it."""
    if not text:
        return
    at, first, tail = 0, 0, []
    while at < len(text):
        upto = min(len(text), at + PART_BYTES)
        while upto < len(text) and terms(text[upto - 1:upto]) and terms(text[upto:upto + 1]):
            upto += 1
        words = tail + terms(text[at:upto])
        yield first, words
        tail = words[-overlap:] if overlap else []
        first += len(words) - len(tail)
        at = upto


def document_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Number of documents holding each word of the (bounded) ``vocabulary``; every task sums before the exchange."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for value in batch["text"]:
                held = set()
                for _, words in _parts(value, 0):
                    held |= known.value.intersection(words)
                for word in held:
                    found[word] = found.get(word, 0) + 1
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}, columns=["word", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(count, "word binary, n bigint")
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}


class WindowIndex:
    """Windows of one block: by rarest word the offsets and lengths to try, by window text its items."""

    def __init__(self, rows: list[tuple[str | None, bytes]], frequency: dict[bytes, int]):
        self.items: dict[bytes, list[str]] = {}
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        tries: dict[bytes, set[tuple[int, int]]] = {}
        for item, window in rows:
            self.items.setdefault(window, []).extend([] if item is None else [item])
        for window in self.items:
            words = window.split(b" ")
            offset = min(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i]))
            tries.setdefault(words[offset], set()).add((offset, len(words)))
        for word, pairs in tries.items():
            self.prefixes[word] = sorted(pairs)

    def hits(self, text: bytes | None, width: int) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit spans (first word, word after the last) and the items that occur."""
        total, spans, found = 0, [], set()
        for first, words in _parts(text, width - 1):
            total = first + len(words)
            for at, word in enumerate(words):
                if word not in self.prefixes:
                    continue
                for offset, length in self.prefixes[word]:
                    start = at - offset
                    if start < 0 or start + length > len(words):
                        continue
                    items = self.items.get(b" ".join(words[start:start + length]))
                    if items is not None:
                        spans.append((first + start, first + start + length))
                        found.update(items)
        return total, merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"


def _looker(index, width: int):
    @F.pandas_udf(_FOUND)
    def look(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            total, spans, ids = index.value.hits(value, width)
            out.append((total, [{"start": a, "end": b} for a, b in spans], sorted(ids)))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return look


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` as a struct column ``row`` with ``n_words``, hit word ``spans`` and the sorted ``items`` that occur.

    Null and blank texts have no words and no hits; an empty benchmark hits nothing; items without an id mark words but are
    not listed; an item id that comes twice is listed once. Rows of ``docs`` are kept one to one, repeated ones too.
    """
    windows = stage(item_windows(items, width), "windows")
    size = windows.agg(F.sum(F.length("window") + F.length(F.coalesce("item_id", F.lit(""))) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    nothing = F.lit(None).cast(_FOUND)
    found = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"), nothing.alias("so_far"))
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        rows = [(r[0], bytes(r[1])) for r in mine.collect()]
        frequency = document_frequency(docs, {w for _, window in rows for w in window.split(b" ")}, text)
        index = context.broadcast(WindowIndex(rows, frequency))

        new = _looker(index, width)("text")
        both = F.struct(
            F.col("new.n_words").alias("n_words"),
            F.when(F.col("so_far").isNull(), F.col("new.spans")).otherwise(F.concat("so_far.spans", "new.spans")).alias("spans"),
            F.when(F.col("so_far").isNull(), F.col("new.items")).otherwise(F.array_union("so_far.items", "new.items")).alias("items"),
        )
        found = found.select("row", "text", "so_far", new.alias("new")).select("row", "text", both.alias("so_far"))
        if block + 1 < blocks:
            found = stage(found, "hits")
    return found.select("row", "so_far.n_words", _joined_spans("so_far.spans").alias("spans"), F.array_sort("so_far.items").alias("items"))


def _joined_spans(name: str):
    """Spans of several blocks in order, overlapping ones joined."""
    step = (
        "CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end THEN concat(slice(acc, 1, size(acc) - 1),"
        " array(named_struct('start', element_at(acc, -1).start, 'end', greatest(s.end, element_at(acc, -1).end))))"
        " ELSE concat(acc, array(s)) END"
    )
    empty = "cast(array() AS array<struct<start: bigint, end: bigint>>)"
    return F.expr(f"aggregate(array_sort({name}), {empty}, (acc, s) -> {step})")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ``spans``."""
    found = find_items(docs, items, width)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        ids.alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their own columns."""
    return find_items(docs, items, width).where(F.size("spans") == 0).select("row.*")
