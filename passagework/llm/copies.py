"""Near copies by exact Jaccard similarity of word shingles, candidates from SimHash fingerprints and MinHash bands.

A text is the set of its 5-word shingles (shorter texts are one shingle). Each of 24 bands keys it by five minima of the
shingles' hashes; a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^24 = 7e-5, a closer pair with less.
The texts whose SimHash fingerprints (of the same shingles) hang together within three bits share one more key, found by the
covering tables of ``simhash``; few pairs at 0.8 are that near, so the bands stand beside it.
Texts of one key are compared exactly, so nothing is linked that is not similar.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.components import connected_components
from passagework.llm.simhash import near_fingerprints, with_fingerprint
from passagework.llm.words import blank_separated
from passagework.plans.stage import stage

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of one bucket that meet in one task; larger buckets are cut into blocks that meet pairwise.
BLOCK = 256
_SLICE = 4096
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor %d" % i) | 1 for i in range(BANDS * ROWS)], np.uint64)
_MIX = np.array([xxhash.xxh64_intdigest(b"mix %d" % i) | 1 for i in range(ROWS)], np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """The distinct runs of ``width`` words; a shorter text is one run, no word gives none."""
    words = blank_separated(text)
    if not words:
        return set()
    width = min(width, len(words))
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def similar(a: set[bytes], b: set[bytes], least: float = SIMILARITY) -> bool:
    """Jaccard similarity of at least ``least``; two sets without members are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    common = len(a & b)
    return common >= least * (len(a) + len(b) - common) - 1e-9


def bands(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The keys of a text, one a band, as signed 64-bit numbers; texts without words share all of them."""
    found = shingles(text, width)
    codes = np.fromiter((xxhash.xxh64_intdigest(s, 5) for s in found), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), _SLICE):
        np.minimum(least, (_FACTORS[:, None] * codes[None, at:at + _SLICE]).min(axis=1), out=least)
    rows = np.concatenate([np.arange(BANDS, dtype=np.uint64)[:, None], least.reshape(BANDS, ROWS)], axis=1)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), 9) for row in rows], np.uint64).view(np.int64)


def text_node(text: str | Column) -> Column:
    """64-bit hash of a text, null as empty: copies are one node."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _forest(names: list[int], sets: list[set[bytes]], first: int, least: float) -> list[int]:
    """Flat links that join what similar pairs join: of all, or of the first ``first`` with the others where there are others."""
    left, out = set(range(len(names))), []
    while left:
        front = [left.pop()]
        while front:
            x = front.pop()
            new = [y for y in left if (first == len(names) or (x < first) != (y < first)) and similar(sets[x], sets[y], least)]
            left.difference_update(new)
            front += new
            out += [v for y in new for v in (names[x], names[y])]
    return out


def similar_links(docs: DataFrame, keyed: DataFrame, text: str = "text", least: float = SIMILARITY, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """Links ``a, b`` between the nodes of ``docs`` that connect what similar pairs sharing a key connect.

    ``keyed`` has node and key once each. Buckets of the same members count once. A bucket is cut into blocks of about
    ``block`` texts by a hash, and each two blocks meet in a task of their own, which returns a forest instead of its pairs.
    """
    busy = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("n > 1")
    busy = busy.groupBy("n", "low", "mark").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = stage(keyed.join(busy.select("key", "n"), "key").select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")), "placed")
    texts = docs.select(text_node(text).alias("node"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    texts = texts.join(placed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    met = placed.join(texts, "node").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = F.struct("node", "text")
    cells = met.groupBy("key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("met"), row)).alias("first"),
        F.collect_list(F.when(F.col("own") > F.col("met"), row)).alias("second"),
    )

    def forests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ends = []
            for at in range(batch.num_rows):
                one, two = batch.column("first")[at].as_py(), batch.column("second")[at].as_py()
                both = one + two
                ends += _forest([r["node"] for r in both], [shingles(r["text"], width) for r in both], len(one), least)
            yield pa.RecordBatch.from_arrays([pa.array(ends[::2], pa.int64()), pa.array(ends[1::2], pa.int64())], names=["a", "b"])

    linked = cells.select("first", "second").mapInArrow(forests, "a bigint, b bigint")
    return linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprint_keys(coded: DataFrame) -> DataFrame:
    """``node, key``: one key for all texts whose ``fingerprint`` links, over any number of links within the radius of ``simhash``."""
    codes = stage(coded.select(F.col("fingerprint").alias("code")).distinct(), "codes")
    joined = stage(connected_components(near_fingerprints(codes)), "near-codes").select(F.col("node").alias("fingerprint"), "component")
    group = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fingerprint"))
    return coded.select("node", "fingerprint").distinct().join(joined, "fingerprint", "left").select("node", group.alias("key"))


def copy_groups(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, node, component`` (of nodes) ``, component_id`` (the smallest id reachable over similar pairs), one row per row of ``docs``; a component without ids has none."""

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bands(t) for t in batch], dtype=object)

    printed = with_fingerprint(docs.select("doc_id", "text"), width=WIDTH)
    coded = stage(printed.select("doc_id", text_node("text").alias("node"), keys(F.col("text").cast("binary")).alias("keys"), "fingerprint"), "bands")
    nodes = stage(coded.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    banded = coded.select("node", F.explode("keys").alias("key"))
    keyed = stage(banded.unionByName(fingerprint_keys(coded)).distinct(), "keyed")
    joined = stage(connected_components(similar_links(docs, keyed, least=least, block=block)), "groups")
    joined = joined.withColumnRenamed("node", "member")
    grouped = nodes.join(joined, nodes.node == joined.member, "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "component").select("node", "component", "component_id")
    return coded.select("doc_id", "node").join(named, "node")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest ``doc_id``, then the smallest hash of the text.

    A group is made of texts, not of ids: rows of one id whose texts are no copies of each other all stay. Of rows that repeat
    id and text one stays. A null id comes after all others.
    """
    groups = stage(copy_groups(docs, least), "copies")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept id"), F.col("first.node").alias("kept node"))
    named = docs.withColumn("copy node", text_node("text"))
    found = named.join(kept, (F.col("copy node") == F.col("kept node")) & F.col("doc_id").eqNullSafe(F.col("kept id")), "left_semi")
    return found.dropDuplicates(["doc_id", "copy node"]).select(*docs.columns)
