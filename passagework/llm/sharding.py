"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, place in the staged table), so equal texts are neighbours. The
splitters that cut the order into pieces of equal bytes are found by counting: the first round counts the exact bytes below
4,095 evenly spaced probes; every further round puts 255 probes into each interval that still holds a splitter, until one
probe is near enough. Counts are sums with map-side combine; only they reach the driver, a bounded number per round. Then the
rows are exchanged once, by piece. A shard is a fixed number of neighbouring pieces, so no task ever holds a whole shard.

An edge between two texts is taken if it is within ``tolerance`` of a shard's bytes, so groups of equal texts stay whole where
that leaves sizes near equal. A larger group is cut inside, by the second and third key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.plans.stage import stage

_KEYS = ("k1", "k2", "k3")
_TOP = (1 << 63) - 1
_FIRST_BITS, _NEXT_BITS = 12, 8
_BOUND = "struct<k1: bigint, k2: bigint, k3: bigint>"


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def splitters(rows: DataFrame, count: int, tolerance: int, fine: int) -> list[tuple | None]:
    """``count - 1`` inclusive upper bounds (k1, k2, k3) of pieces of near equal ``size``; None lies below all rows.

    ``tolerance`` and ``fine`` are bytes: an edge between two first keys may be off by ``tolerance``, any edge by ``fine``.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    found: list[tuple | None] = [None] * (count - 1)
    if not total:
        return found
    # what is still sought: splitter -> (values of the keys before, key number, depth in bits, prefix, bytes before, bound before)
    sought = {i: ((), 0, 0, 0, 0, None) for i in range(count - 1)}
    while sought:
        intervals = sorted({(at[0], at[1], at[2], at[3]) for at in sought.values()})
        counted = _count(rows, intervals)
        nxt = {}
        for i, (fixed, level, depth, prefix, before, bound) in sought.items():
            want = total * (i + 1) / count
            for bucket, size, n, low, high in counted[(fixed, level, depth, prefix)]:
                if before + size >= want:
                    break
                before, bound = before + size, (*fixed, high) + (_TOP,) * (2 - level)
            else:
                found[i] = bound
                continue
            after = (*fixed, high) + (_TOP,) * (2 - level)
            off = min(want - before, before + size - want)
            if off <= fine or n == 1 or (low == high and (level == 2 or level == 0 and off <= tolerance)):
                found[i] = bound if want - before <= before + size - want else after
            elif low == high:
                nxt[i] = ((*fixed, low), level + 1, 0, 0, before, bound)
            else:
                nxt[i] = (fixed, level, depth + (_NEXT_BITS if depth else _FIRST_BITS), bucket, before, bound)
        sought = nxt
    return found


def _count(rows: DataFrame, intervals: list[tuple]) -> dict:
    """For each interval its non-empty buckets in order: bucket, bytes, rows, lowest and highest key."""
    out: dict = {}
    for level, depth in sorted({(level, depth) for _, level, depth, _ in intervals}):
        mine = [x for x in intervals if (x[1], x[2]) == (level, depth)]
        bits = depth + (_NEXT_BITS if depth else _FIRST_BITS)
        key = F.col(_KEYS[level])
        part = rows
        if depth or level:
            kind = ", ".join(["no int", *(f"f{j} bigint" for j in range(level)), "p bigint"])
            wanted = rows.sparkSession.createDataFrame([(no, *x[0], x[3]) for no, x in enumerate(mine)], kind)
            on = [F.col(f"f{j}") == F.col(_KEYS[j]) for j in range(level)]
            on.append(F.col("p") == (F.shiftright(key, 64 - depth) if depth else F.lit(0)))
            part = rows.join(F.broadcast(wanted), on)
        else:
            part = rows.withColumn("no", F.lit(0))
        buckets = part.groupBy("no", F.shiftright(key, 64 - min(bits, 64)).alias("bucket") if bits < 64 else key.alias("bucket"))
        sums = buckets.agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for x in mine:
            out[x] = []
        for r in sums.orderBy("no", "bucket").collect():
            out[mine[r[0]]].append(tuple(r)[1:])
    return out


def shard_documents(docs: DataFrame, shards: int = 40, pieces: int = 16, tolerance: float = 0.05, keep: tuple[str, ...] = ("doc_id",),
                    id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: a struct ``row`` of ``keep``, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shard sizes are near equal and ``grown_shard`` is null. Slots count from 0 in each shard without
    gaps, in key order. A null text has 16 bytes and no checksum; null ids are allowed; repeated rows are rows of their own.
    An empty table gives no rows; with fewer rows than shards some shards stay empty. A single document larger than a shard
    cannot be cut, so its shard is larger.
    """
    keyed = docs.select(
        F.struct(*keep).alias("row"), text_bytes(text).alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(id_column).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )
    rows = stage(keyed, "keyed")
    count = shards * pieces
    shard_size = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    bounds = splitters(rows.select("size", *_KEYS), count, int(tolerance * shard_size), int(shard_size / pieces / 64))
    placed = _with_piece(rows, bounds)
    sizes = {r[0]: r[1] for r in placed.groupBy("piece").count().collect()}
    starts, start = [], 0
    for piece in range(count):
        start = 0 if piece % pieces == 0 else start
        starts.append((piece, start))
        start += sizes.get(piece, 0)
    offsets = rows.sparkSession.createDataFrame(starts, "piece int, before bigint")
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*_KEYS)) - 1
    sorted_rows = placed.withColumn("place", place).join(F.broadcast(offsets), "piece")
    return sorted_rows.select(
        "row", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        (F.col("before") + F.col("place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_piece(rows: DataFrame, bounds: list[tuple | None]) -> DataFrame:
    """``piece``: the number of bounds below the row's key, from a table of one row per first probe interval."""
    shift = 64 - _FIRST_BITS
    inside: dict[int, list] = {}
    for b in bounds:
        if b is not None:
            inside.setdefault(b[0] >> shift, []).append(b)
    table, passed = [], sum(b is None for b in bounds)
    for bucket in range(-(1 << _FIRST_BITS - 1), 1 << _FIRST_BITS - 1):
        table.append((bucket, passed, inside.get(bucket, [])))
        passed += len(inside.get(bucket, []))
    lookup = rows.sparkSession.createDataFrame(table, f"bucket bigint, passed int, bounds array<{_BOUND}>")
    key = F.struct(*_KEYS)
    below = F.size(F.filter("bounds", lambda b: b < key))
    joined = rows.join(F.broadcast(lookup), F.shiftright("k1", shift) == F.col("bucket"))
    return joined.withColumn("piece", (F.col("passed") + below).cast("int")).drop("bucket", "passed", "bounds")
