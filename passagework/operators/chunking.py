"""Chunking pages by a hierarchy of delimiters, as array expressions: no UDF and no shuffle.

Contract (sizes in code points):
1. a page no longer than ``size`` is one chunk;
2. otherwise it is split at a level, each piece keeping its trailing delimiter, and neighbouring pieces are packed left to
   right while their sum fits; packed runs are one piece when they hold a single over-long piece, which goes to the next level;
3. after the last level one left-to-right pass merges neighbours when either is shorter than ``min_chars`` and both fit.
Chunks of a page tile it exactly: their texts joined give the page.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import has_text
from passagework.functions.tokens import bpe_chunker
from passagework.plans.checks import first_reason, split_on_reason
from passagework.plans.running import number_blocks, running_sums
from passagework.plans.stage import stage

# Defaults of the chunker and of the ingest job.
DEFAULT_SIZE = 2048
DEFAULT_MIN_CHARS = 24
DEFAULT_INGEST_SIZE = 8123
DEFAULT_TOKENIZER = "character"
TOKENIZERS = ("character", "gpt2")
SUPPORTED_METHOD = "recursive"

_BLANK = r"[ \t\n\r\f\x0B]"
# Pieces of every level, each with its trailing delimiter; a sentence takes one blank after its end.
PARAGRAPHS = r"(?s)\n\n+|.+?(?:\n\n+|\z)"
LINES = r"[^\n]*\n+|[^\n]+"
SENTENCES = r"[^.!?]*[.!?]+[ \t\n\r\f\x0B]?|[^.!?]+"
WORDS = r"[^ \t\n\r\f\x0B]*[ \t\n\r\f\x0B]+|[^ \t\n\r\f\x0B]+"
SENTENCES_AND_LINES = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
LEVELS = (PARAGRAPHS, LINES, SENTENCES, WORDS)
# The same piece ends, told by the characters around a position.
_ENDS = {
    PARAGRAPHS: r"(?<=\n\n)(?!\n)",
    LINES: r"(?<=\n)(?!\n)",
    SENTENCES: rf"(?<=[.!?]{_BLANK})|(?<=[.!?])(?![.!?]|{_BLANK})",
    WORDS: rf"(?<={_BLANK})(?!{_BLANK})",
    SENTENCES_AND_LINES: r"(?<=[.!?\n])(?![.!?\n])",
}
# A chunk without the delimiter is one piece at these levels.
_NEEDED = {PARAGRAPHS: r"'\n\n'", LINES: r"'\n'"}
_CHUNK = "struct<length:int,text:string>"
_BLOCK = 64


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``, so that it is computed once per row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matches(text: str, pattern: str) -> str:
    return f"transform(regexp_extract_all({text}, {pattern}, 0), t -> named_struct('length', length(t), 'text', t))"


def _split_level(chunks: str, pattern: str, size: str) -> str:
    """Greedy packing in one match: the longest stretch up to ``size`` that ends where a piece ends, else one long piece."""
    packed = f"concat('(?s).{{1,', {size}, r'}}(?:{_ENDS[pattern]}|\\z)|{pattern.removeprefix('(?s)')}')"
    whole = f"c.length <= {size}"
    if pattern in _NEEDED:
        whole += f" OR NOT contains(c.text, {_NEEDED[pattern]})"
    return f"flatten(transform({chunks}, c -> CASE WHEN {whole} THEN array(c) ELSE {_matches('c.text', packed)} END))"


def _cut(chunks: str, size: str) -> str:
    """Whatever is still too long is cut every ``size`` code points."""
    cut = _matches("c.text", f"concat('(?s).{{1,', {size}, '}}')")
    return f"flatten(transform({chunks}, c -> CASE WHEN c.length <= {size} THEN array(c) ELSE {cut} END))"


def _merge_short(chunks: str, size: str, min_chars: str) -> str:
    """Left-to-right merge of short neighbours.

    Nothing merges across two neighbours that are both long enough, so the list is cut there first and only the clusters
    around short chunks are folded. A fold copies what it has gathered at every step, so it gathers per block.
    """
    empty = f"cast(array() as array<{_CHUNK}>)"
    joined = "named_struct('length', a.last.length + n.length, 'text', concat(a.last.text, n.text))"
    inner = (
        f"aggregate(k, named_struct('done', {empty}, 'last', o.last), (a, n) -> CASE"
        f" WHEN (a.last.length < {min_chars} OR n.length < {min_chars}) AND a.last.length + n.length <= {size}"
        f" THEN named_struct('done', a.done, 'last', {joined})"
        " ELSE named_struct('done', concat(a.done, array(a.last)), 'last', n) END)"
    )
    step = _let("r", inner, "named_struct('done', concat(o.done, r.done), 'last', r.last)")
    blocks = f"transform(sequence(0, (size(g) - 2) div {_BLOCK}), b -> slice(g, b * {_BLOCK} + 2, {_BLOCK}))"
    fold = (
        f"aggregate({blocks}, named_struct('done', {empty}, 'last', g[0]), (o, k) -> {step},"
        " o -> concat(o.done, array(o.last)))"
    )
    apart = f"i = size(m) - 1 OR (m[i].length >= {min_chars} AND m[i + 1].length >= {min_chars})"
    ends = f"filter(transform(m, (c, i) -> CASE WHEN {apart} THEN i + 1 END), e -> e IS NOT NULL)"
    start = "CASE WHEN j = 0 THEN 0 ELSE ends[j - 1] END"
    groups = f"transform(ends, (e, j) -> slice(m, {start} + 1, e - ({start})))"
    merged = f"flatten(transform({groups}, g -> CASE WHEN size(g) = 1 THEN g ELSE {fold} END))"
    return _let("m", chunks, _let("ends", ends, merged))


def _whole(text: str) -> str:
    return f"array(named_struct('length', length({text}), 'text', {text}))"


def _starts(chunks: str) -> str:
    """Start of every chunk: sums of the lengths before it, per block of chunks and then within the blocks."""
    none = "cast(array() as array<int>)"

    def sums(items: str, length: str, at: str) -> str:
        step = f"named_struct('at', a.at + {length}, 'out', concat(a.out, array(a.at)))"
        return f"aggregate({items}, named_struct('at', {at}, 'out', {none}), (a, n) -> {step}, a -> a.out)"

    blocks = f"transform(sequence(0, (size({chunks}) - 1) div {_BLOCK}), k -> slice({chunks}, k * {_BLOCK} + 1, {_BLOCK}))"
    totals = "transform(blocks, k -> aggregate(k, 0, (s, c) -> s + c.length))"
    inside = f"flatten(transform(blocks, (k, i) -> {sums('k', 'n.length', 'before[i]')}))"
    return _let("blocks", blocks, _let("before", sums(totals, "n", "0"), inside))


def recursive_pieces(text: str, size: str, min_chars: str) -> str:
    """SQL expression: chunks of a text column; sizes are SQL expressions, so they may be columns."""
    chunks = _whole(text)
    for pattern in LEVELS:
        chunks = _split_level(chunks, pattern, size)
    chunks = _merge_short(_cut(chunks, size), size, min_chars)
    return f"CASE WHEN length({text}) <= {size} THEN {_whole(text)} ELSE {chunks} END"


def sentence_pieces(text: str, size: str, min_chars: str) -> str:
    """One level only: sentence and line ends, packed up to ``size``; a single longer sentence stays whole."""
    chunks = _merge_short(_split_level(_whole(text), SENTENCES_AND_LINES, size), size, min_chars)
    return f"CASE WHEN length({text}) <= {size} THEN {_whole(text)} ELSE {chunks} END"


def _packed(pages: DataFrame, pieces: str) -> DataFrame:
    """The pieces of a page and their starts as one array ``__packed`` in the place of the content."""
    rows = pages.withColumn("__pieces", F.expr(pieces)).withColumn("__starts", F.expr(_starts("__pieces")))
    return rows.selectExpr(*[f"`{c}`" for c in pages.columns if c != "content"], "arrays_zip(__pieces, __starts) AS __packed")


def _unpacked(rows: DataFrame) -> DataFrame:
    # For the plain posexplode Spark adds a filter on the array's size, and computes the whole array there again for every use of it.
    return rows.selectExpr("*", "posexplode_outer(__packed) AS (piece_no, __c)").filter("piece_no IS NOT NULL").selectExpr(
        *[f"`{c}`" for c in rows.columns if c != "__packed"],
        "piece_no",
        "__c.__pieces.text AS text",
        "__c.__starts AS start_index",
        "__c.__starts + __c.__pieces.length AS end_index",
        "__c.__pieces.length AS token_count",
    )


def _explode(pages: DataFrame, pieces: str) -> DataFrame:
    return _unpacked(_packed(pages, pieces))


def non_blank(pages: DataFrame) -> DataFrame:
    return pages.filter(has_text(F.col("content")))


def _explode_by_tokens(pages: DataFrame, size: Column, min_chars: Column, vocabulary: str | None) -> DataFrame:
    chunks = bpe_chunker(LEVELS, vocabulary)(F.col("content"), size, min_chars)
    rows = pages.select(*[c for c in pages.columns if c != "content"], F.posexplode(chunks).alias("piece_no", "__c"))
    return rows.select("*", "__c.*").drop("__c")


def recursive_chunks(
    pages: DataFrame,
    size: int = DEFAULT_SIZE,
    min_chars: int = DEFAULT_MIN_CHARS,
    tokenizer: str = DEFAULT_TOKENIZER,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per chunk of every non-blank page; other page columns (metadata too) are copied to each chunk.

    ``tokenizer`` says what ``size`` and ``token_count`` measure: code points (``character``) or BPE tokens (``gpt2``,
    where a packed chunk counts the tokens of its pieces). ``piece_no`` is the position within the page;
    :func:`number_chunks` turns it into the position within the document.
    """
    if tokenizer == "character":
        return _explode(non_blank(pages), recursive_pieces("content", str(size), str(min_chars)))
    if tokenizer == "gpt2":
        return _explode_by_tokens(non_blank(pages), F.lit(size), F.lit(min_chars), vocabulary)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def pack_sentences(pages: DataFrame, size: int = DEFAULT_SIZE, min_chars: int = DEFAULT_MIN_CHARS) -> DataFrame:
    return _explode(non_blank(pages), sentence_pieces("content", str(size), str(min_chars)))


def number_chunks(chunks: DataFrame, document: str = "document_id", page: str = "page_number") -> DataFrame:
    """Adds ``chunk_index``: 0-based position in the document, pages in order; under each config where there is a ``config_hash``.

    Only per-page counts are accumulated along a document. The chunks are read twice, so stage them first when they come
    from a long pipeline (see ``plans.stage``).
    """
    keys = [document, *(c for c in ("config_hash",) if c in chunks.columns)]
    counts = chunks.groupBy(*keys, page).agg((F.max("piece_no") + 1).alias("pieces"))
    before = running_sums(
        counts, keys, [page], number_blocks(F.col(page)), {"before": F.col("pieces")}, inclusive=False
    ).drop("pieces")
    joined = chunks.join(before, [*keys, page])
    return joined.withColumn("chunk_index", (F.col("before") + F.col("piece_no")).cast("int")).drop("before")


def numbered_chunks(
    pages: DataFrame, size: int = DEFAULT_SIZE, min_chars: int = DEFAULT_MIN_CHARS, document: str = "document_id", page: str = "page_number"
) -> DataFrame:
    """:func:`recursive_chunks` by characters with ``chunk_index``, without a second pass over the texts.

    The pieces of a page stay one array while their counts are summed along the document; pages are cut once, and what is
    summed is one number a page. Only then the arrays become rows.
    """
    packed = _packed(non_blank(pages), recursive_pieces("content", str(size), str(min_chars)))
    staged = stage(packed.withColumn("__count", F.size("__packed")), "pieces")
    counts = staged.select(document, page, "__count").groupBy(document, page).agg(F.max("__count").alias("__count"))
    before = running_sums(counts, [document], [page], number_blocks(F.col(page)), {"__before": F.col("__count")}, inclusive=False)
    rows = _unpacked(staged.join(before.drop("__count"), [document, page]).drop("__count"))
    return rows.withColumn("chunk_index", (F.col("__before") + F.col("piece_no")).cast("int")).drop("__before")


def chunk_with_configs(
    pages: DataFrame, configs: DataFrame, vocabulary: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunks of every page under every config of its handler, and the configs that were refused.

    ``pages`` has a ``parser`` column naming the handler that made it; ``configs`` holds config_hash, parser,
    chunking_method, tokenizer and optional chunk_size / min_characters_per_chunk.
    """
    method_ok = F.coalesce(F.col("chunking_method") == SUPPORTED_METHOD, F.lit(False))
    tokenizer = F.coalesce(F.col("tokenizer"), F.lit(DEFAULT_TOKENIZER))
    accepted, refused = split_on_reason(
        configs.withColumn("tokenizer", tokenizer),
        first_reason(
            (~method_ok, "chunking method is not recursive"),
            (~tokenizer.isin(*TOKENIZERS), "unknown tokenizer"),
        ),
    )
    sized = accepted.select(
        "config_hash",
        "parser",
        "tokenizer",
        F.coalesce(F.col("chunk_size").cast("int"), F.lit(DEFAULT_SIZE)).alias("__size"),
        F.coalesce(F.col("min_characters_per_chunk").cast("int"), F.lit(DEFAULT_MIN_CHARS)).alias("__min"),
    )
    rows = non_blank(pages).join(sized, "parser")
    counted = {name: rows.filter(F.col("tokenizer") == name).drop("tokenizer") for name in TOKENIZERS}
    by_length = _explode(counted["character"], recursive_pieces("content", "__size", "__min"))
    by_tokens = _explode_by_tokens(counted["gpt2"], F.col("__size"), F.col("__min"), vocabulary)
    return by_length.unionByName(by_tokens).drop("__size", "__min"), refused


def unchunked(documents: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents that gave no chunk; they are reported and not written."""
    return documents.join(chunks.select(document).distinct(), document, "left_anti")
