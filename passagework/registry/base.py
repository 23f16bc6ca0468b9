"""Registration, table loading and SQL fragments shared by the registered queries."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import WHITE_SPACE
from passagework.operators import chunking
from passagework.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(ship_package(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one page."""
    docs = load(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("content"), "lang", "source"
    )


def line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document as a page."""
    from passagework.operators.pages import physical_pages

    docs = load(spark, folder, "documents").withColumnRenamed("doc_id", "document_id")
    return physical_pages(docs, "document_id", "text", "\n")


NON_BLANK = "[^" + WHITE_SPACE[1:]


def sql_pack(pieces: str, joins: str) -> str:
    return (
        f"list_reduce(list_transform({pieces}, lambda q: [q]), lambda acc, q: CASE WHEN {joins}"
        " THEN list_concat(acc[:-2], [acc[-1] || q[1]]) ELSE list_concat(acc, q) END)"
    )


def sql_level(chunks: str, pieces: str, size: str) -> str:
    packed = sql_pack(pieces, f"length(acc[-1]) + length(q[1]) <= {size}")
    return f"flatten(list_transform({chunks}, lambda c: CASE WHEN length(c) <= {size} THEN [c] ELSE {packed} END))"


def sql_merge(chunks: str, size: str, least: str) -> str:
    return sql_pack(
        chunks,
        f"(length(acc[-1]) < {least} OR length(q[1]) < {least}) AND length(acc[-1]) + length(q[1]) <= {size}",
    )


def sql_chunk_tables(
    source: str, size: str, least: str = "24", prefix: str = "", patterns=chunking.LEVELS, cut: bool = True, keep: str = ""
) -> str:
    """CTEs ending in ``{prefix}ch``: document_id, page_number, piece_no, text, start_index, end_index.

    ``source`` is a relation with document_id, page_number, content and the columns named in ``keep`` (", a, b").
    """
    names, ctes = f"{prefix}l", []
    ctes.append(
        f"{names}0 AS (SELECT document_id, page_number{keep}, [content] AS cs FROM {source}"
        f" WHERE regexp_matches(content, '{NON_BLANK}'))"
    )
    n = 0
    for pattern in patterns:
        level = sql_level("cs", f"regexp_extract_all(c, '{pattern}')", size)
        ctes.append(f"{names}{n + 1} AS (SELECT document_id, page_number{keep}, {level} AS cs FROM {names}{n})")
        n += 1
    if cut:
        parts = f"list_transform(range(0, (length(c) + {size} - 1) // {size}), lambda i: substring(c, i * {size} + 1, {size}))"
        ctes.append(
            f"{names}{n + 1} AS (SELECT document_id, page_number{keep}, {sql_level('cs', parts, size)} AS cs FROM {names}{n})"
        )
        n += 1
    ctes.append(
        f"{names}{n + 1} AS (SELECT document_id, page_number{keep}, {sql_merge('cs', size, least)} AS cs FROM {names}{n})"
    )
    ctes.append(
        f"{prefix}flat AS (SELECT document_id, page_number{keep}, unnest(cs) AS text,"
        f" CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS piece_no FROM {names}{n + 1})"
    )
    before = "sum(length(text)) OVER (PARTITION BY document_id, page_number{keep} ORDER BY piece_no)".replace("{keep}", keep)
    ctes.append(
        f"{prefix}ch AS (SELECT *, CAST({before} - length(text) AS INTEGER) AS start_index,"
        f" CAST({before} AS INTEGER) AS end_index FROM {prefix}flat)"
    )
    return ",\n".join(ctes)


DOC_PAGES_SQL = "pg AS (SELECT doc_id AS document_id, 1 AS page_number, text AS content, lang, source FROM documents)"
LINE_PAGES_SQL = (
    "pg AS (SELECT doc_id AS document_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS page_number,"
    " unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
)


def sql_words(text: str) -> str:
    """List of the words of a text: runs of letters and digits, A-Z lower-cased."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}]+')"


def sql_hashed(source: str, keys: str, dim: int, name: str) -> str:
    """CTE ``name``: keys, b, w of the hashed word counts of ``source``.text."""
    return (
        f"{name}_t AS (SELECT {keys}, word, count(*) AS n FROM (SELECT {keys}, unnest({sql_words('text')}) AS word"
        f" FROM {source}) GROUP BY ALL),\n"
        f"{name} AS (SELECT {keys}, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {dim} AS b,"
        f" CAST(sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN n ELSE -n END) AS BIGINT) AS w"
        f" FROM {name}_t GROUP BY ALL HAVING sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN n ELSE -n END) <> 0)"
    )


def sql_hashed_topk(k: str, dim: int, queries: str, name: str = "hits", keys: str = "document_id, piece_no") -> str:
    """CTEs ending in ``name``: query_id, keys, rank, score; queries/chunks are relations ``queries`` and ``ch``."""
    parts = keys.split(", ")
    on = ", ".join(f"c.{x}" for x in parts)
    same = " AND ".join(f"d.{x} = cn.{x}" for x in parts)
    return ",\n".join(
        [
            sql_hashed(queries, "query_id", dim, "hq"),
            sql_hashed("ch", keys, dim, "hc"),
            "qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM hq GROUP BY query_id)",
            f"cn AS (SELECT {keys}, sqrt(sum(w * w)) AS n FROM hc GROUP BY {keys})",
            f"dots AS (SELECT q.query_id, {on}, sum(q.w * c.w) AS dot FROM hq q JOIN hc c ON q.b = c.b GROUP BY q.query_id, {on})",
            f"scored AS (SELECT d.*, round(d.dot / (qn.n * cn.n), 9) AS score FROM dots d JOIN qn ON d.query_id = qn.query_id"
            f" JOIN cn ON {same})",
            f"{name} AS (SELECT query_id, {keys}, score, CAST(row_number() OVER (PARTITION BY query_id"
            f" ORDER BY score DESC, {keys}) AS INTEGER) AS rank FROM scored QUALIFY rank <= {k})",
        ]
    )
