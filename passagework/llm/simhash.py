"""SimHash near-duplicates found by covering locality-sensitive hashing.

A fingerprint has 64 bits; documents link when at most three differ. Bit ``i`` carries a non-zero vector ``m(i)`` of four
binary digits. For each of the 15 non-zero vectors ``v`` a table keys a fingerprint by the bits with odd ``<m(i), v>``.
Three differing bits span at most three of the four dimensions, so some ``v`` is orthogonal to all of them and its table
ignores them: every pair within the radius shares a key in some table, without exception.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.components import connected_components
from passagework.llm.words import blank_separated
from passagework.plans.stage import stage

RADIUS = 3
#: Fingerprints of one bucket that meet in one task; larger buckets are cut into blocks that meet pairwise.
BLOCK = 1024
_SLICE = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of the covering tables, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    digits = [i % vectors + 1 for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(digits) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of all word shingles, repeats included; shorter texts are one shingle, no word gives zero."""
    words = blank_separated(text)
    if not words:
        return 0
    width = min(width, len(words))
    line, last = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, ends = (last - [len(w) + 1 for w in words]).tolist(), (last - 1).tolist()
    total, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _SLICE):
        upto = min(at + _SLICE, total)
        hashes = np.fromiter((digest(line[starts[i]:ends[i + width - 1]], 42) for i in range(at, upto)), np.uint64, upto - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 3) -> DataFrame:
    """``docs`` with the long column ``name``; null and blank texts get zero."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, width) for t in batch], dtype="int64")

    return docs.withColumn(name, hashed(F.col(text).cast("binary")))


def star(linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each member of each group of the symmetric 0/1 matrix ``linked``; lone rows give nothing."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & left)
            left[new], front = False, new
            out += [(root, int(n)) for n in new]
    return out


def _forest(own: np.ndarray, other: np.ndarray, radius: int) -> list[int]:
    """Flat links that join, within a cell, what pairs of ``own`` (or of ``own`` with ``other``) within the radius join."""
    if len(own) + len(other) == 2:
        a, b = [*own.tolist(), *other.tolist()]
        return [a, b] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else []
    if not len(other):
        near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
        names = own.tolist()
    else:
        cross = np.bitwise_count((own[:, None] ^ other[None, :]).view(np.uint64)) <= radius
        near = np.zeros((len(own) + len(other),) * 2, bool)
        near[: len(own), len(own):], near[len(own):, : len(own)] = cross, cross.T
        names = own.tolist() + other.tolist()
    return [x for a, b in star(near) for x in (names[a], names[b])]


def near_fingerprints(codes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that connect exactly the distinct ``code`` values which pairs within ``radius`` connect.

    A bucket is never gathered whole: it is cut into blocks of about ``block`` codes and each two blocks meet in a task of
    their own, which returns a forest instead of its pairs.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))]))
    rows = codes.select("code", keys.alias("k")).select("code", "k.*")
    busy = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = rows.join(busy, ["t", "key"]).select("t", "key", "code", blocks.alias("blocks"), F.pmod(F.xxhash64("code"), blocks).cast("int").alias("own"))
    met = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.groupBy("t", "key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("met"), F.col("code"))).alias("first"),
        F.collect_list(F.when(F.col("own") > F.col("met"), F.col("code"))).alias("second"),
    )

    @F.pandas_udf("array<bigint>")
    def forest(first: pd.Series, second: pd.Series) -> pd.Series:
        pairs = zip(first, second)
        return pd.Series([_forest(np.asarray(a, np.int64), np.asarray(b, np.int64), radius) for a, b in pairs], dtype=object)

    linked = cells.select(forest("first", "second").alias("f")).where(F.size("f") > 0)
    ends = F.explode(F.expr("transform(sequence(0, size(f) - 1, 2), i -> struct(f[i] AS a, f[i + 1] AS b))"))
    return linked.select(ends.alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (long) and ``component_id``, the smallest id reachable over links, one row per document.

    Null and blank texts have fingerprint zero and link like any other. Documents of one fingerprint form one node, so
    copies never meet each other. Rows without an id take part; a component of such rows only has a null ``component_id``.
    Repeated rows are returned as often as they come. Texts are read once; what is staged is one id and one number a row.
    """
    return _grouped(docs, radius, id_column, text).select("doc_id", "fingerprint", "component_id")


def _grouped(docs: DataFrame, radius: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups with their ``component``, the fingerprint that names it."""
    coded = stage(with_fingerprint(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    codes = stage(coded.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first_id")), "codes")
    joined = stage(connected_components(near_fingerprints(codes, radius)), "groups")
    grouped = codes.join(joined, codes.code == joined.node, "left").select("code", "first_id", F.coalesce("component", "code").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "component").select(F.col("code").alias("fingerprint"), "component", "component_id")
    return coded.join(named, "fingerprint").select("doc_id", "fingerprint", "component", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: the smallest ``doc_id``, then the smallest fingerprint.

    A group is made of fingerprints, not of ids: rows of one id in several groups all stay. Of rows that repeat id and
    fingerprint one stays. A null id comes after all others.
    """
    groups = stage(_grouped(docs, radius), "copies")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fingerprint")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept id"), F.col("first.fingerprint").alias("kept code"))
    coded = with_fingerprint(docs, name="simhash code")
    found = coded.join(kept, (F.col("simhash code") == F.col("kept code")) & F.col("doc_id").eqNullSafe(F.col("kept id")), "left_semi")
    return found.dropDuplicates(["doc_id", "simhash code"]).select(*docs.columns)
