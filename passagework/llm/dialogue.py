"""Conversation structure repair by the auction algorithm for shortest paths.

The edits of a conversation are a lattice: a node is (rows passed, state), a state is what the roles kept so far end in
(nothing, system, user, assistant), an arc is one edit with a whole cost. Every node has a price; an arc from i to j of cost c
keeps ``price(i) <= c + price(j)``. A path grows from an origin: its last node moves on along an arc that attains the least
``c + price(j)``, or, if its price is lower than that, the price is raised and the path contracts by that node. When the path
reaches a node whose price has converged, all prices on it have. Origins are taken from the last layer to the first and prices
stay, so each origin needs a few steps. Arcs with ``price(i) = c + price(j)`` are tight; tracing them by the least edit
initial gives the cheapest edits that come first in ASCII order (no cheapest edits are a prefix of others).

Conversations are cut into blocks of bounded rows and bytes along one global order, so a long one spreads over many tasks. A
block is solved towards each state that it may leave in; what joins the blocks of a conversation is a table of four by four
costs and edits a block, without texts. The digest of the repaired texts is one stream per conversation, read in batches.
"""
from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.plans.stage import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Most rows, and most bytes of roles and texts, of a block.
ROWS, BYTES = 2048, 4 << 20
#: States: nothing yet, system, user, assistant; the role that may come next and the state after it.
_NEXT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_REACH = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
_NAME = {"u": "user", "a": "assistant"}
_FAR = 1 << 50
_BLANK = r"^[\x20\x09-\x0D]*$"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by ``crc32(conv_id:turn) % 20``, and ``there``: false for a dropped row.

    Nulls read as one blank, also in the checksum's text; ``conv_id`` and ``turn`` themselves stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    spoilt = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), (kind != 0).alias("there"), copies.alias("copy")).drop("copy")


def arcs(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, rows passed, state after, cost) of the edits at a row; ``code`` is its role initial and fault, None past the end.

    Faults: ``d`` must be deleted, ``t`` is truncated, ``-`` is neither. In the order of the initials.
    """
    after, role = _NEXT[state]
    insert = ("I", 0, after, INSERT)
    if code is None:
        return [insert]
    out = [("D", 1, state, DELETE), insert]
    if code[-1] != "d":
        more = TRUNCATED if code[-1] == "t" else 0
        if (state, code[:-1]) in _AFTER:
            out.append(("K", 1, _AFTER[state, code[:-1]], KEEP + more))
        out.append(("R", 1, after, REROLE + more))
    return out


def converged_prices(codes: tuple[str, ...], ends: tuple[int, ...]) -> list[list[int]]:
    """Price of each (row, state): the least cost from there to the end, where leaving in state s costs ``ends[s]``."""
    n = len(codes)
    price: list[list[int]] = [[0] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        code = codes[i] if i < n else None
        onward = ends if i == n else price[i + 1]
        # no way on costs less than the best state still in reach, so these prices are feasible, and far states start far
        price[i] = here = [min(onward[t] for t in _REACH[s]) for s in range(4)]
        options = [arcs(code, s) for s in range(4)]
        settled = [False] * 4
        for origin in range(4):
            path = [origin]
            while not settled[origin]:
                s = path[-1]
                least, head = (ends[s], None) if i == n else (_FAR << 1, None)
                for _, step, to, cost in options[s]:
                    offer = cost + (price[i + 1][to] if step else here[to])
                    if offer < least or (offer == least and step):
                        least, head = offer, None if step else to
                if here[s] < least:
                    here[s] = least  # contraction
                    if len(path) > 1:
                        path.pop()
                elif head is None or settled[head]:
                    for passed in path:
                        settled[passed] = True
                else:
                    path.append(head)  # extension
    return price


def trace(codes: tuple[str, ...], price: list[list[int]], ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """The tight path from (0, state) that takes the least initial each time, and the state in which it leaves."""
    i, out, n = 0, [], len(codes)
    while i < n or price[n][state] != ends[state]:
        for initial, step, to, cost in arcs(codes[i] if i < n else None, state):
            if price[i][state] == cost + price[i + step][to]:
                out.append(initial)
                i, state = i + step, to
                break
    return "".join(out), state


@functools.lru_cache(4096)
def block_table(codes: tuple[str, ...]) -> tuple[tuple[tuple[int, str], ...], ...]:
    """[state before][state after] -> (least cost, edits), cost ``_FAR`` or more where there is no way."""
    found = []
    for leave in range(4):
        ends = tuple(0 if s == leave else _FAR for s in range(4))
        price = converged_prices(codes, ends)
        found.append([(price[0][s], trace(codes, price, ends, s)[0] if price[0][s] < _FAR else "") for s in range(4)])
    return tuple(tuple(found[leave][s] for leave in range(4)) for s in range(4))


def _before(a: list[str], b: list[str]) -> bool:
    """Whether the joined strings of ``a`` come before those of ``b``."""
    i = j = x = y = 0
    while i < len(a) and j < len(b):
        size = min(len(a[i]) - x, len(b[j]) - y)
        one, two = a[i][x:x + size], b[j][y:y + size]
        if one != two:
            return one < two
        x, y = x + size, y + size
        if x == len(a[i]):
            i, x = i + 1, 0
        if y == len(b[j]):
            j, y = j + 1, 0
    return i == len(a) and j < len(b)


def join_blocks(tables: list) -> tuple[int, list[tuple[int, str]]]:
    """Least cost of a whole conversation and, per block, (state before, edits), from its blocks' tables in order."""
    price, tails = [0, _FAR, _FAR, 0], [None] * 4  # a tail: (edits, state after, rest)
    for table in reversed(tables):
        now, rest = [], []
        for s in range(4):
            least = min(table[s][e][0] + price[e] for e in range(4))
            best = None
            for e in range(4):
                if table[s][e][0] + price[e] == least < _FAR:
                    tail = (table[s][e][1], e, tails[e])
                    if best is None or _before(_joined(tail), _joined(best)):
                        best = tail
            now.append(min(least, _FAR))
            rest.append(best)
        price, tails = now, rest
    out, state, tail = [], 0, tails[0]
    while tail is not None:
        out.append((state, tail[0]))
        state, tail = tail[1], tail[2]
    return price[0], out


class _Lazy:
    """A tail's edits as a list that is walked only as far as needed."""

    def __init__(self, tail):
        self.parts, self.tail = [], tail

    def __len__(self):
        while self.tail is not None and not self.tail[0]:
            self.tail = self.tail[2]
        return len(self.parts) + (self.tail is not None)

    def __getitem__(self, at):
        while at >= len(self.parts):
            self.parts.append(self.tail[0])
            self.tail = self.tail[2]
            while self.tail is not None and not self.tail[0]:
                self.tail = self.tail[2]
        return self.parts[at]


def _joined(tail) -> _Lazy:
    return _Lazy(tail)


def repaired_lines(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of what a block's edits leave, from the state before it."""
    out, i = [], 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        after, role = _NEXT[state]
        if edit == "K":
            role, after = roles[i], _AFTER[state, roles[i][:1]]
        else:
            role = _NAME[role]
        out.append(f"{role}:{'' if edit == 'I' else texts[i]}")
        i, state = i + (edit != "I"), after
    return out


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one conversation as block rows with their table of costs and edits."""
    part, nth, open_, held = TaskContext.get().partitionId(), 0, None, []

    def row() -> pa.RecordBatch:
        codes = tuple(c for c, *_ in held)
        table = block_table(codes)
        values = [
            ([open_], kind), ([(part << 33) + nth], pa.int64()), ([[r for _, r, _ in held]], pa.list_(pa.string())),
            ([[t for _, _, t in held]], pa.list_(pa.string())), ([[c for line in table for c, _ in line]], pa.list_(pa.int64())),
            ([[e for line in table for _, e in line]], pa.list_(pa.string())), ([sum(a[:-1] + b[:-1] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))], pa.int64()),
            ([codes[0][:-1]], pa.string()), ([codes[-1][:-1]], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in values], names=["conv_id", "block", "roles", "texts", "costs", "edits", "illegal", "first", "last"])

    weight = 0
    for batch in batches:
        keys, roles, texts, faults = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault"))
        for key, role, text, fault in zip(keys, roles, texts, faults):
            more = len(role) + len(text)
            if held and (key != open_ or len(held) >= rows or weight + more > size):
                yield row()
                nth, held, weight = nth + 1, [], 0
            open_ = key
            held.append((role[:1] + ("d" if fault in ("blank", "duplicate") else "t" if fault == "truncated" else "-"), role, text))
            weight += more
    if held:
        yield row()


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows that are ``there``, numbered (``nth``), with their first fault: blank, duplicate, truncated or null."""
    numbered = stage(rows.where("there").drop("there").withColumn("nth", F.monotonically_increasing_id()), "damaged")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "nth")
    same = F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")), 256)
    first = numbered.groupBy("conv_id", "role", same.alias("digest")).agg(F.min(order).alias("at")).select(F.col("at.nth").alias("nth"), F.lit(True).alias("first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("text").rlike(_BLANK.replace("$", r"\z")), "blank").when(F.col("first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return numbered.join(first, "nth", "left").withColumn("fault", fault).drop("first")


def repaired(rows: DataFrame, block_rows: int = ROWS, block_bytes: int = BYTES) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (``conv_id, turn, role, text, there``; roles and texts not null).

    ``gaps, blank, duplicate, truncated, illegal, cost`` (longs), ``audit`` and ``repaired_sha256``. Rows are taken by turn,
    nulls first, then role, text; equal rows follow each other. A null ``conv_id`` is a conversation of its own. One without
    rows that are there gives zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns
    are not looked at.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "there")
    every = rows.select("conv_id").distinct()
    faulty = stage(with_faults(rows), "faults")
    named = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    turns = faulty.groupBy("conv_id", "turn").agg(*[named(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = faulty.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text", "fault")
    name = rows.schema["conv_id"].dataType.simpleString()
    kind = f"conv_id {name}, block bigint, roles array<string>, texts array<string>, costs array<bigint>, edits array<string>, illegal bigint, first string, last string"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    blocks = stage(ordered.mapInArrow(lambda batches: _blocks(batches, arrow, block_rows, block_bytes), kind), "blocks")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = (r for batch in batches for r in batch.to_pylist())
        for conv_id, group in itertools.groupby(rows_of, lambda r: r["conv_id"]):
            found = list(group)
            tables = [[[(r["costs"][4 * s + e], r["edits"][4 * s + e]) for e in range(4)] for s in range(4)] for r in found]
            cost, ways = join_blocks(tables)
            seams = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
            columns = [
                ([r["block"] for r in found], pa.int64()), ([s for s, _ in ways], pa.int32()), ([e for _, e in ways], pa.string()),
                ([cost] * len(found), pa.int64()), ([r["illegal"] + seams * (not at) for at, r in enumerate(found)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["block", "state", "edits", "cost", "illegal"])

    light = blocks.select("conv_id", "block", "costs", "edits", "illegal", "first", "last").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
    plan = light.mapInArrow(folded, "block bigint, state int, edits string, cost bigint, illegal bigint")
    chosen = blocks.select("conv_id", "block", "roles", "texts").join(plan, "block")  # a block's number is its own

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = (r for batch in batches for r in batch.to_pylist())
        for conv_id, group in itertools.groupby(rows_of, lambda r: r["conv_id"]):
            illegal, audit, digest, between = 0, [], hashlib.sha256(), ""
            for r in group:
                illegal += r["illegal"]
                audit.append(r["edits"])
                lines = repaired_lines(r["edits"], r["state"], r["roles"], r["texts"])
                if lines:
                    digest.update((between + "\n".join(lines)).encode())
                    between = "\n"
            columns = [([conv_id], arrow), ([r["cost"]], pa.int64()), ([illegal], pa.int64()), (["".join(audit)], pa.string()), ([digest.hexdigest()], pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], names=["conv_id", "cost", "illegal", "audit", "repaired_sha256"])

    lined = chosen.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
    done = lined.select("conv_id", "state", "edits", "roles", "texts", "cost", "illegal").mapInArrow(
        streamed, f"conv_id {name}, cost bigint, illegal bigint, audit string, repaired_sha256 string"
    )
    both = every.alias("e").join(counts.alias("c"), F.expr("e.conv_id <=> c.conv_id"), "left").join(done.alias("r"), F.expr("e.conv_id <=> r.conv_id"), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("e.conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
