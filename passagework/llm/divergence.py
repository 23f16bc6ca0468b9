r"""How far the sources of a language differ in their terms, by count-level bitmaps.

A kept term (in ``least_docs`` documents of its language or more) has a bit position in one chunk of its language. A group (a
source of a language) has, per chunk and count, one bitmap of the terms it holds exactly that often. Two bitmaps of two
groups, ANDed and counted, give the number of terms with that pair of counts: a joint cell. A cell is multiplied by the
divergence of the two smoothed shares, which depend on the counts alone. Cells with a zero count are not stored: they are the
complement of the others, so ``f(c, d) - f(c, 0) - f(0, d) + f(0, 0)`` is summed over stored cells and the rest comes from the
groups' own level counts.

All arithmetic is on whole numbers. Chunks hold terms of like frequency, so rare chunks have few count levels. What one task
gathers is bounded: a chunk has 512 terms, so a group has at most 512 bitmaps there, and blocks of 64 sources meet pairwise.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.plans.stage import stage

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of a chunk (bits of its bitmaps); sources of a block.
BITS, BLOCK = 512, 64
_WORDS = BITS // 64
#: Entries that a task counts before it hands them on; joint cells that it holds at once.
_HELD, _CELLS = 300_000, 1 << 19
_SALTS = 64
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    r"""The runs of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``, A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n`` (occurrences) ``, docs`` (documents with it); nulls are ''.

    Each task counts its own documents first, so only sums of many rows are exchanged.
    """
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (one, two), (n, d) in held.items():
            found = list(n)
            columns = [pa.array([one] * len(found), pa.string()), pa.array([two] * len(found), pa.string()),
                       pa.array(found, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in found], pa.int64())]
            batch = pa.RecordBatch.from_arrays(columns, schema=kind)
            yield from (batch.slice(at, 50_000) for at in range(0, batch.num_rows, 50_000))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            one, two = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text")
            for at in range(batch.num_rows):
                n, d = held.setdefault((one[at], two[at]), (Counter(), Counter()))
                found = terms(texts[at].as_py())
                before = len(n)
                n.update(found)
                d.update(set(found))
                size += len(n) - before
                if size > _HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    given = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))
    rows = given.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str | Column, total: str | Column, kept: str | Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))`` in whole numbers of 38 digits."""
    wide = [(F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)") for c in (count, total, kept)]
    top, bottom = (wide[0] + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), wide[1] + wide[2]
    return F.call_function("div", top, bottom).cast("bigint") + 1


def _gap(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)``; the square of a difference of shares fits in 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    """What the stored cells of one chunk add to each pair of sources of two blocks (``side`` 0 and 1; one block: all 0)."""
    lang, alone = rows["lang"].iloc[0], rows["low"].iloc[0] == rows["high"].iloc[0]
    sides = []
    for side in (0,) if alone else (0, 1):
        part = rows[rows["side"] == side].sort_values("source", kind="stable")
        names, starts = np.unique(part["source"].to_numpy(object).astype(str), return_index=True)
        bits = np.column_stack([part[f"w{i}"].to_numpy(np.int64) for i in range(_WORDS)]).view(np.uint64) if len(part) else None
        sides.append((names, starts, bits, part["p"].to_numpy(np.int64), part["p0"].to_numpy(np.int64)))
    (names, starts, bits, p, p0), other = sides[0], sides[-1]
    out: list[tuple] = []
    if not len(names) or not len(other[0]):
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])
    there = np.zeros((len(names), len(other[0])), np.int64)  # value of side 0 against side 1
    back = np.zeros_like(there)
    ends = np.append(starts[1:], len(p))
    slab = max(1, _CELLS // max(1, len(other[3])))
    for s in range(len(names)):
        for at in range(starts[s], ends[s], slab):
            upto = min(at + slab, ends[s])
            joint = np.zeros((upto - at, len(other[3])), np.int64)
            for w in range(_WORDS):
                joint += np.bitwise_count(bits[at:upto, w, None] & other[2][None, :, w])
            hit = np.nonzero(joint)
            c, d = hit[0] + at, hit[1]
            many = joint[hit]
            for into, (a, a0, i), (b, b0, j) in ((there, (p, p0, c), (other[3], other[4], d)), (back, (other[3], other[4], d), (p, p0, c))):
                x, x0, y, y0 = a[i], a0[i], b[j], b0[j]
                f = lambda u, v: (u - v) * (u - v) // v
                more = many * (f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0))
                sums = np.zeros(len(other[3]), np.int64)
                np.add.at(sums, d, more)
                into[s] += np.add.reduceat(sums, other[1])
    for i, one in enumerate(names):
        for j, two in enumerate(other[0]):
            if one != two:
                out.append((lang, one, two, int(there[i, j])))
                if not alone:
                    out.append((lang, two, one, int(back[i, j])))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _placed(vocabulary: DataFrame) -> DataFrame:
    """Each kept term's chunk (``class, bucket, sub``) and bit; terms of like frequency share chunks of at most ``BITS``."""
    with_class = vocabulary.withColumn("class", F.floor(F.log2("all")).cast("int"))
    sizes = with_class.groupBy("lang", "class").agg(F.ceil(F.count("*") / BITS).cast("bigint").alias("buckets"))
    # a class may hold a third of all terms, so it meets its size under several salts
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))))
    own = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(_SALTS).cast("bigint"))
    dealt = with_class.withColumn("salt", own).join(salted, ["lang", "class", "salt"]).withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    place = F.row_number().over(Window.partitionBy("lang", "class", "bucket").orderBy("term")) - 1
    placed = dealt.withColumn("place", place)
    return placed.select("lang", "term", "all", "class", "bucket", F.floor(F.col("place") / BITS).cast("int").alias("sub"), (F.col("place") % BITS).alias("bit"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP,
               block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs, also one without terms.

    Part ``pair``: each other source of the language with the summed divergence from it (0 without kept terms), all ranks.
    Part ``term``: the kept terms more frequent than in the language as a whole, by divergence from it, ``top`` ranks. Ranks
    count from 1, value descending, then item by UTF-8 bytes. Null texts have no words, null languages and sources are named
    ''. Repeated rows are documents of their own. An empty table gives no rows; other columns are not looked at.
    """
    named = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"))
    counts = stage(term_counts(docs, lang, source, text), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    placed = stage(_placed(vocabulary.drop("docs")), "vocabulary")
    totals = placed.groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("all").alias("lang_n"))
    kept = stage(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("held_n"), F.count("*").alias("held"))
    groups = named.distinct().join(own, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["held_n", "held", "kept_terms", "lang_n"])
    # without kept terms every share is 1 and no cell exists
    zero = F.when(F.col("kept_terms") == 0, F.lit(1)).otherwise(_share(F.lit(0), "held_n", "kept_terms"))
    groups = stage(groups.withColumn("p0", zero), "sources")

    # the cells with a zero count: level counts of one group against the zero share of the other
    shared = kept.join(groups.select("lang", "source", "held_n", "kept_terms", "lang_n", "p0"), ["lang", "source"])
    level = ["lang", "source", "class", "bucket", "sub", "n", "p0"]
    words = [F.bit_or(F.expr(f"IF(bit BETWEEN {64 * i} AND {64 * i + 63}, shiftleft(1L, CAST(bit - {64 * i} AS INT)), 0L)")).alias(f"w{i}") for i in range(_WORDS)]
    bitmaps = shared.groupBy(*level, "held_n", "kept_terms").agg(*words, F.count("*").alias("m"))
    bitmaps = stage(bitmaps.withColumn("p", _share("n", "held_n", "kept_terms")).drop("held_n", "kept_terms"), "bitmaps")
    levels = bitmaps.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
    away = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    met = levels.join(away, "lang").where("source <> other")
    sided = [("source", "other", _gap("p", "q0"), _gap("p0", "q0")), ("other", "source", _gap("q0", "p"), _gap("q0", "p0"))]
    rest = [met.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), (F.col("m") * (full - none)).alias("value")) for a, b, full, none in sided]
    pairs = groups.select("lang", "source", "p0", "kept_terms").join(away, "lang").where("source <> other")
    floor = pairs.select("lang", "source", F.col("other").alias("item"), (F.col("kept_terms") * _gap("p0", "q0")).alias("value"))

    # the stored cells: blocks of sources meet per chunk
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = bitmaps.join(blocks, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = mine.select(
        "lang", "class", "bucket", "sub", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"),
        (F.col("own") > F.col("met")).cast("int").alias("side"), "source", "p", "p0", *[f"w{i}" for i in range(_WORDS)],
    )
    stored = cell.groupBy("lang", "class", "bucket", "sub", "low", "high").applyInPandas(_cells, "lang string, source string, item string, value bigint")
    every = floor.unionByName(rest[0]).unionByName(rest[1]).unionByName(stored)
    pair = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    whole = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(whole))

    ratio = shared.withColumn("p", _share("n", "held_n", "kept_terms")).withColumn("q", _share("all", "lang_n", "kept_terms")).where("p > q")
    term = ratio.select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"), F.lit("term").alias("part"))
    term = term.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
