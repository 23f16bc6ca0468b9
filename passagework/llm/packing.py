"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (one number per length up to the limit) reaches the driver. All patterns of two or three
lengths that fill a sequence exactly are enumerated, and their repeat counts are fitted to the histogram by non-negative
least squares (active set). Counts are rounded down, largest first, within what the histogram has left; the residual pieces are
packed best fit, longest first, again on counts instead of pieces. Where one length is far more frequent than its complements,
a part of the fitted counts leaves a residual that packs better, so a few shares of them are tried. The finished plan is a table of slots: the pieces of one length,
numbered 0, 1, ..., take the slots of that length in order. Numbering is distributed (counts per block, then offsets).
"""
from __future__ import annotations

import json
import pathlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.plans.stage import stage

LIMIT, END = 1024, 2
#: Distinct words whose ids a worker remembers; longest word that it remembers; characters that it encodes at once.
_KNOWN, _WORD, _AT_ONCE = 700_000, 48, 6_000_000
#: Patterns taken into the fit at once; most rounds of the fit.
_ADDED, _ROUNDS = 48, 40
#: Shares of the fitted counts that are tried.
_SHARES = (1.0, 0.85, 0.7, 0.5, 0.3)


#: A blank that no word follows; a line end between words; what may end a word of letters.
_ODD, _LINE, _ENDS = re.compile(r" (?=\s|\Z)"), re.compile(r"(?<=\S)\n(?=\S)"), ".,;:!?"
#: Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Words(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of a word after a blank or, with a line end before it, of a word after none.

    No token of a byte-level vocabulary crosses the borders used here: before a blank that a non-blank follows, around a single
    line end, between a letter and the marks that end a word. So words are encoded apart and remembered.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.merger = _merger(vocabulary)

    def __missing__(self, word: str) -> bytes:
        bare = word[:1] == "\n"
        lines = _LINE.split(word[bare:])
        if len(lines) > 1:
            first = self["\n" + lines[0] if bare else lines[0]]
            return first + b"".join(self["\n\n"] + self["\n" + line] for line in lines[1:])
        core = word.rstrip(_ENDS)
        if len(core) < len(word) and core[-1:].isalpha():
            ids = self[core] + self["\n" + word[len(core):]]
        else:
            ids = np.array(self._encoded(word[1:] if bare else " " + word), "<u4").tobytes()
        if len(word) <= _WORD:
            if len(self) >= _KNOWN:
                self.clear()
            self[word] = ids
        return ids

    def _encoded(self, text: str) -> list[int]:
        letters = text.lstrip(" ")
        if self.merger and letters.isalpha() and len(text) - len(letters) < 2 and max(letters) < "\u0250":  # one run of letters is one word of the vocabulary's own rule
            return self.merger.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text."""
        return self.all_ids([text])[0].tobytes()

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text with blanks that no word follows; these stay with what is before them."""
        joined, words = text.split(" "), []
        for w in joined:
            if words and (not w or w[0].isspace()):
                words[-1] += " " + w
            else:
                words.append(w)
        first = np.array(self.tokenizer.encode(words[0], add_special_tokens=False).ids, "<u4").tobytes()
        return np.frombuffer(first + b"".join(map(self.__getitem__, words[1:])), "<u4")

    def all_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; each distinct word of them is looked up once."""
        out = [np.zeros(0, "<u4")] * len(texts)
        plain = [at for at, t in enumerate(texts) if t and not t[0].isspace() and not _ODD.search(t)]
        for at in set(range(len(texts))).difference(plain):
            if texts[at]:
                out[at] = self._odd(texts[at])
        if not plain:
            return out
        split = pc.split_pattern(pa.array(["\n" + texts[at] for at in plain], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        found = [self[w] for w in words.dictionary.to_pylist()]
        sizes = np.array([len(b) // 4 for b in found], np.int64)
        starts, blob, at = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4"), np.asarray(words.indices)
        size = sizes[at]
        ends = np.cumsum(size)
        ids = blob[np.arange(ends[-1]) + np.repeat(starts[at] - ends + size, size)]
        borders = np.concatenate([[0], ends])[np.asarray(split.offsets)]
        for n, place in enumerate(plain):
            out[place] = ids[borders[n]:borders[n + 1]]
        return out


def _merger(vocabulary: str):
    """A faster encoder of single words, where the vocabulary merges in the order of its ids; None where it does not."""
    import tiktoken

    model = json.loads(vocabulary)["model"]
    ids = model["vocab"]
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) < len(merged):
        return None
    back = {c: b for b, c in _BYTES.items()}
    ranks = {bytes(back[c] for c in token): n for token, n in ids.items() if all(c in back for c in token)}
    if {n for token, n in ranks.items() if len(token) > 1} - set(merged):  # a special token, which no merge makes
        ranks = {token: n for token, n in ranks.items() if len(token) == 1 or n in set(merged)}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


_LOADED: dict[int, _Words] = {}


def _words(vocabulary: str) -> _Words:
    """One memory of words per worker process and vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _LOADED:
        _LOADED[key] = _Words(vocabulary)
    return _LOADED[key]


def _encoded(words: _Words, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of a column of texts, ``_AT_ONCE`` characters at a time."""
    held, size, first = [], 0, 0
    for at in range(len(texts)):
        held.append(texts[at].as_py())
        size += len(held[-1] or "")
        if size > _AT_ONCE or at + 1 == len(texts):
            yield from enumerate(words.all_ids(held), first)
            held, size, first = [], 0, at + 1


def cut(length: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else pieces of ``limit`` after a shorter first one."""
    first = length % limit
    starts = [0] if first else []
    starts += range(first, length, limit)
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], length])]))


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end: int = END, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, block, nth`` and, if wanted, ``ids``: the pieces of all documents.

    ``vocabulary`` is the content of a tokenizer file. A piece is the ``nth`` of its length in its ``block`` (task).
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)  # its size is fixed
    more = ", ids binary" if keep_ids else ""
    last = np.array([end], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, numbers = _words(spec.value), TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7 + keep_ids)]
            docs_at, texts = [], batch.column("text")
            for at, ids in _encoded(words, texts):
                ids = ids.tobytes() + last
                for piece, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                    part = ids[4 * start:4 * (start + length)]
                    docs_at.append(at)
                    values = [piece, start, length, zlib.crc32(part), block, numbers[length], part]
                    for into, value in zip(rows[1:], values):
                        into.append(value)
                    numbers[length] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = [batch.column("doc_id").take(pa.array(docs_at, pa.int64())), *[pa.array(v, k) for v, k in zip(rows[1:], kinds)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth", "ids"][:len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(encoded, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block int, nth bigint{more}")


def fill_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Rows of three lengths a <= b <= c, a = 0 for pairs, that add up to ``limit``; ``lengths`` ascend."""
    there = np.zeros(limit + 1, bool)
    there[lengths] = True
    found = [np.zeros((0, 3), int)]
    for a in [0, *lengths[lengths * 3 <= limit]]:
        b = lengths[(lengths >= a) & (2 * lengths <= limit - a)]
        b = b[there[limit - a - b]]
        found.append(np.column_stack([np.full(len(b), a), b, limit - a - b]))
    return np.concatenate(found)


def fit_counts(patterns: np.ndarray, wanted: np.ndarray, limit: int) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that come nearest to ``wanted`` (pieces per length) by least squares.

    Rows are weighed by the root of their length: a long piece left over costs more than a short one. Active set: each round
    takes in patterns without a common length, by gain, solves for the active ones and lets go those that would be negative.
    The fit ends where what is left over is no more than rounding leaves anyway, or where no pattern lowers the error.
    """
    weight = (np.arange(limit + 1) / limit) ** 0.5
    target, x, active = weight * wanted, np.zeros(len(patterns)), np.zeros(0, int)
    dense = np.zeros((limit + 1, 0))
    best, stalled = (np.inf, x), 0
    for _ in range(_ROUNDS):
        left = target - dense @ x[active]
        error = float(left @ left)
        better = error < best[0] * (1 - 1e-3)
        best, stalled = ((error, x.copy()), 0) if better else (best, stalled + 1)
        loose = np.divide(np.abs(left), weight, out=np.zeros_like(left), where=weight > 0).sum()
        gain = (weight * left)[patterns].sum(axis=1)
        gain[active] = -np.inf
        order, busy, new = np.argsort(-gain, kind="stable")[:8192], np.zeros(limit + 1, bool), []
        for p in order[gain[order] > 1e-7 * (1 + np.abs(target).max())]:
            if len(new) < _ADDED and not busy[patterns[p]].any():
                busy[patterns[p][patterns[p] > 0]] = True
                new.append(p)
        if not new or stalled > 4 or loose <= max(0.3 * len(active), 1e-5 * wanted.sum()):
            break
        active = np.concatenate([active, np.array(new, int)])
        more = np.zeros((limit + 1, len(new)))
        for i in range(3):
            np.add.at(more, (patterns[new, i], np.arange(len(new))), 1.0)
        dense = np.concatenate([dense, more * weight[:, None]], axis=1)
        while len(active):
            z = np.linalg.solve(dense.T @ dense + 1e-7 * np.eye(len(active)), dense.T @ target)
            stays = z > 1e-6
            if stays.all():
                break
            active, dense = active[stays], dense[:, stays]
        x = np.zeros(len(patterns))
        x[active] = z
    return best[1]


def best_fit(left: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold all pieces of ``left``: longest first, each where the least room is left."""
    open_: dict[int, list] = {}
    for length in sorted(left, reverse=True):
        count = left[length]
        while count > 0:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = limit // length
                whole, rest = divmod(count, each)
                for n, repeats in ((each, whole), (rest, 1)):
                    if n and repeats:
                        open_.setdefault(limit - n * length, []).append(((length,) * n, repeats))
                count = 0
                continue
            held, repeats = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = room // length
            used = min(repeats, count // each)
            if used:
                open_.setdefault(room - each * length, []).append((held + (length,) * each, used))
                count -= used * each
            if used < repeats:
                rest = count if count < each else 0
                if rest:
                    open_.setdefault(room - rest * length, []).append((held + (length,) * rest, 1))
                    count -= rest
                if repeats - used - (rest > 0):
                    open_.setdefault(room, []).append((held, repeats - used - (rest > 0)))
    return [pair for pairs in open_.values() for pair in pairs]


def pack_plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for a histogram length -> pieces; every piece has its place."""
    left = {n: c for n, c in histogram.items() if c}
    plan = [((limit,), left.pop(limit))] if limit in left else []
    lengths = np.array(sorted(left), int)
    patterns = fill_patterns(lengths, limit) if len(lengths) else np.zeros((0, 3), int)
    if not len(patterns):
        return plan + best_fit(left, limit)
    wanted = np.zeros(limit + 1)
    wanted[lengths] = [left[n] for n in lengths]
    x, tried = fit_counts(patterns, wanted, limit), []
    rows = [([int(n) for n in patterns[p] if n], x[p]) for p in np.argsort(-x, kind="stable")[:int((x > 1e-6).sum())]]
    for share in _SHARES:
        rest, fitted = dict(left), []
        for row, count in rows:
            repeats = min([int(share * count + 1e-6), *[rest[n] // row.count(n) for n in row]])
            if repeats:
                fitted.append((tuple(row), repeats))
                for n in row:
                    rest[n] -= repeats
        tried.append(fitted + best_fit({n: c for n, c in rest.items() if c}, limit))
    return plan + min(tried, key=lambda rows: sum(repeats for _, repeats in rows))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, per sequence, first sequence, offset), ascending: where the pieces of a length go."""
    out, given, sequence = [], {}, 0
    for lengths, repeats in plan:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            number = given.get(length, 0)
            out.append((length, number, each, sequence, offset))
            given[length] = number + each * repeats
            offset += each * length
        sequence += repeats
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(staged: DataFrame, table: np.ndarray) -> DataFrame:
    """``staged`` pieces with ``sequence_id`` and ``offset``; ``table`` is bounded by lengths and patterns."""
    known = staged.sparkSession.sparkContext.broadcast(table)
    per_block = staged.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_block.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = staged.join(starts, ["length", "block"]).withColumn("number", F.col("before") + F.col("nth")).drop("before", "nth", "block")
    kept = [f for f in numbered.schema.fields if f.name != "number"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = known.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            nth, each = number - rows[at, 1], rows[at, 2]
            sequence, offset = rows[at, 3] + nth // each, rows[at, 4] + nth % each * length
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*[f.name for f in kept], "sequence_id", "offset"])

    return numbered.mapInArrow(placed, f"{kind}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end: int = END, id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``, little-endian 32-bit) of every piece.

    A document is its ids and ``end``; longer ones are cut. A null or empty text is ``end`` alone; null and repeated ids are
    allowed, each row is a document. No sequence is longer than ``limit``, and its pieces follow each other from offset 0.
    An empty table gives no rows; other columns are not looked at. Texts are encoded once, into a staged table.
    """
    staged = stage(pieces(docs, vocabulary, limit, end, id_column, text, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(staged, slots(pack_plan(histogram, limit)))


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (array of ints), one row a packed sequence, from ``packed(..., keep_ids=True)``."""

    @F.pandas_udf("array<bigint>")
    def numbers(parts):
        import pandas as pd

        return pd.Series([np.frombuffer(b, "<u4").astype(np.int64) for b in parts], dtype=object)

    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces_with_ids.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", numbers("ids").alias("ids"))


def read_vocabulary(path: str) -> str:
    """Content of a tokenizer file on the driver's machine."""
    return pathlib.Path(path).read_text(encoding="utf-8")
