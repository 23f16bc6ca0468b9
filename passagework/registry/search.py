"""Vector, hashed-text and approximate retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.functions.metadata import page_number_of
from passagework.operators import chunking, embedding, retrieval
from passagework.plans.nearest import nearest
from passagework.plans.stage import stage
from passagework.registry.base import (
    DOC_PAGES_SQL, document_pages, load, query, sql_chunk_tables, sql_hashed_topk,
)

DIM = 256
WIDE = 1 << 18


def vector_queries(spark, folder):
    return load(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vector_chunks(spark, folder):
    """Every vector is chunk 0 of the document with its number."""
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding", "label"
    )


def named_documents(spark, folder):
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return load(spark, folder, "documents").select(F.col("doc_id").alias("id"), name.alias("file_name"))


def _vector_sql(score: str, order: str, k: str = "5", extra: str = "", where: str = "true") -> str:
    """Ranked pairs of all vectors with all vectors."""
    return f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS document_id, 0 AS chunk_index, q.label AS q_label, c.label AS c_label,
  round({score}, 9) AS score FROM n q, n c WHERE {where}),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, document_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= {k}){extra}"""


COSINE_SQL = "list_dot_product(q.v, c.v) / (q.norm * c.norm)"
COSINE_HITS_SQL = _vector_sql(COSINE_SQL, "score DESC")
# Chunks belong to a document: vectors without one (the smallest tables have some) are no chunks.
OWNED_HITS_SQL = _vector_sql(COSINE_SQL, "score DESC", where="c.vec_id IN (SELECT doc_id FROM documents)")


@query(
    "cosine_topk",
    f"""WITH {OWNED_HITS_SQL}
SELECT query_id, rank, document_id, chunk_index, round(score, 6) AS score, text AS content, source || '/' || doc_id AS file_name
FROM hits JOIN documents ON document_id = doc_id""",
)
def cosine_topk(spark, folder):
    texts = load(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    chunks = vector_chunks(spark, folder).join(texts, "document_id")
    hits = retrieval.search(vector_queries(spark, folder), chunks, named_documents(spark, folder), 5)
    return hits.select(
        "query_id", "rank", "document_id", "chunk_index", F.round("score", 6).alias("score"), "content", "file_name"
    )


@query(
    "cosine_pairs",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
 / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""",
)
def cosine_pairs(spark, folder):
    a = load(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = load(spark, folder, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("score"))


def _metric_query(metric):
    def run(spark, folder):
        hits = retrieval.search(vector_queries(spark, folder), vector_chunks(spark, folder), k=5, metric=metric)
        return hits.select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))

    return run


_RANKED = "SELECT query_id, rank, document_id, round(score, 6) AS score FROM hits"
query(
    "l2_topk",
    "WITH " + _vector_sql("sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", "score ASC") + f" {_RANKED}",
)(_metric_query("l2"))
query("inner_product_topk", "WITH " + _vector_sql("list_dot_product(q.v, c.v)", "score DESC") + f" {_RANKED}")(_metric_query("inner"))


@query("per_request_topk", "WITH " + _vector_sql(COSINE_SQL, "score DESC", "coalesce(nullif(q_label, 0), 15)") + f" {_RANKED}")
def per_request_topk(spark, folder):
    """Requests ask for as many results as their label says; label 0 asks for none and gets the default."""
    queries = vector_queries(spark, folder).withColumn("top_k", F.nullif("label", F.lit(0)))
    hits = retrieval.search(queries, vector_chunks(spark, folder), k=retrieval.BATCH_TOP_K)
    return hits.select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))


@query("config_filtered_topk", "WITH " + _vector_sql(COSINE_SQL, "score DESC", where="c.label >= 5") + f" {_RANKED}")
def config_filtered_topk(spark, folder):
    version = F.when(F.col("label") < 5, "one").otherwise("two")
    chunks = vector_chunks(spark, folder).withColumn("extraction_config_hash", version)
    hits = retrieval.search(vector_queries(spark, folder), chunks, k=5, config_hash="two")
    return hits.select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))


@query(
    "request_validation",
    """WITH r AS (SELECT item_id, CASE WHEN contains(text, chr(10)) THEN '' ELSE text END AS question,
  CASE WHEN length(text) <= 300 THEN length(text) - 150 END AS top_k FROM benchmark)
SELECT item_id, CASE WHEN question = '' THEN 'question is empty' WHEN top_k < 1 THEN 'top_k is below 1' END AS reason FROM r""",
)
def request_validation(spark, folder):
    """Texts with a line break become empty questions; the requested number follows the length of the text."""
    size = F.length("text")
    requests = load(spark, folder, "benchmark").select(
        "item_id", F.when(F.col("text").contains("\n"), "").otherwise(F.col("text")).alias("question"),
        F.when(size <= 300, size - 150).alias("top_k"),
    )
    good, bad = retrieval.validate_requests(requests)
    return good.select("item_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("item_id", "reason"))


# -- hashed texts ------------------------------------------------------------------------------------------------------


def text_chunks(spark, folder, dim=DIM):
    """The stored chunk table: texts, hashed vectors and metadata of all documents, written once and read back."""
    chunks = chunking.recursive_chunks(document_pages(spark, folder))
    vectors = embedding.embed_chunks(chunks, embedding.hashing_provider(dim), f"hashing-{dim}")
    meta = F.concat(F.lit('{"page_number":'), F.col("page_number").cast("string"), F.lit("}"))
    return stage(
        vectors.select(
            "document_id", F.col("piece_no").alias("chunk_index"), F.col("text").alias("content"), "embedding", meta.alias("metadata")
        ),
        "chunks",
    )


def text_queries(spark, folder, dim=DIM):
    items = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embedding.embed_chunks(items, embedding.hashing_provider(dim), f"hashing-{dim}")


def text_hits(spark, folder, k):
    return retrieval.search(text_queries(spark, folder), text_chunks(spark, folder), named_documents(spark, folder), k)


ITEMS_SQL = "items AS (SELECT item_id AS query_id, text FROM benchmark)"


def text_hits_sql(k, dim=DIM, items=ITEMS_SQL):
    """CTEs ending in found: query_id, rank, document_id, chunk_index, score, content, file_name, page_number."""
    return f"""{DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}, {items}, {sql_hashed_topk(str(k), dim, 'items')},
found AS (SELECT h.query_id, h.rank, h.document_id, h.piece_no AS chunk_index, h.score, ch.text AS content,
  d.source || '/' || d.doc_id AS file_name, 1 AS page_number FROM hits h JOIN ch ON h.document_id = ch.document_id AND h.piece_no = ch.piece_no
  JOIN documents d ON d.doc_id = h.document_id)"""


@query(
    "batch_topk",
    f"""WITH {text_hits_sql(15)} SELECT query_id, rank, document_id, chunk_index, score, file_name, page_number FROM found""",
)
def batch_topk(spark, folder):
    """Scores have 9 decimals, as in the ranking; a second rounding would fall apart on halves."""
    return text_hits(spark, folder, retrieval.BATCH_TOP_K).select(
        "query_id", "rank", "document_id", "chunk_index", "score", "file_name", "page_number"
    )


@query(
    "sparse_topk",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}, {ITEMS_SQL}, {sql_hashed_topk('5', WIDE, 'items')}
SELECT query_id, rank, document_id, piece_no AS chunk_index, round(score, 6) AS score FROM hits""",
)
def sparse_topk(spark, folder):
    chunks = chunking.recursive_chunks(document_pages(spark, folder)).select(
        "document_id", F.col("piece_no").alias("chunk_index"), "text"
    )
    items = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieval.sparse_search(
        embedding.hashed_counts(items, "text", WIDE), embedding.hashed_counts(chunks, "text", WIDE), 5
    )
    return hits.select("query_id", "rank", "document_id", "chunk_index", F.round("score", 6).alias("score"))


@query(
    "best_match",
    f"""WITH items AS (SELECT item_id AS query_id, text FROM benchmark), ch AS (SELECT doc_id AS document_id, text FROM documents),
{sql_hashed_topk('1', DIM, 'items', keys='document_id')}
SELECT i.query_id, h.document_id, round(h.score, 6) AS score FROM items i LEFT JOIN hits h ON i.query_id = h.query_id AND h.score > 0""",
)
def best_match(spark, folder):
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    corpus = embedding.embed_chunks(docs, embedding.hashing_provider(DIM), "hashing")
    found = retrieval.best_match(text_queries(spark, folder), corpus, "document_id")
    return found.select("query_id", "document_id", F.round("score", 6).alias("score"))


@query(
    "metadata_page_number",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END AS page_number FROM events""",
)
def metadata_page_number(spark, folder):
    """Properties of clicks are renamed to page_number; the other events have none."""
    renamed = F.when(F.col("event_type") == "click", F.replace("props", F.lit('"k"'), F.lit('"page_number"'))).otherwise(F.col("props"))
    return load(spark, folder, "events").select("event_id", page_number_of(renamed).alias("page_number"))


@query(
    "source_accumulation",
    f"""WITH {OWNED_HITS_SQL}
SELECT query_id // 8 AS request_id, count(*) AS sources, string_agg(source || '/' || doc_id, ' ' ORDER BY query_id, rank) AS names
FROM hits JOIN documents ON document_id = doc_id GROUP BY query_id // 8""",
)
def source_accumulation(spark, folder):
    """Eight neighbouring searches belong to one request; the query number is the order of its calls."""
    queries = vector_queries(spark, folder)
    texts = load(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.lit("{}").alias("metadata")
    )
    hits = retrieval.search(queries, vector_chunks(spark, folder).join(texts, "document_id"), named_documents(spark, folder), 5)
    calls = hits.withColumn("request_id", F.floor(F.col("query_id") / 8)).withColumnRenamed("query_id", "call_no")
    sources = retrieval.accumulate_sources(calls)
    return sources.select(
        "request_id", F.size("sources").cast("bigint").alias("sources"),
        F.array_join(F.transform("sources", lambda s: s["file_name"]), " ").alias("names"),
    )


# -- approximate search ------------------------------------------------------------------------------------------------

LISTS_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
most AS (SELECT 8 * CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 8 AS lists FROM e),
drawn AS (SELECT row_number() OVER (ORDER BY md5(vec_id || '|0'), vec_id) - 1 AS list_no, list_transform(v, lambda x: x / norm) AS w
  FROM n WHERE norm > 0 QUALIFY list_no < (SELECT lists FROM most)),
pivot_rows AS (SELECT min(list_no) AS list_no, w FROM drawn GROUP BY w),
nearest_lists AS (SELECT vec_id, list_no, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, w), 9) DESC, list_no) AS place
  FROM e, pivot_rows),
cand AS (SELECT q.vec_id AS query_id, c.vec_id AS document_id FROM nearest_lists q JOIN nearest_lists c ON q.list_no = c.list_no
  WHERE c.place = 1 AND q.place <= greatest(1, (SELECT count(*) * 45 // 100 FROM pivot_rows))),
near AS (SELECT query_id, document_id, round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 9) AS score
  FROM cand JOIN n q ON q.vec_id = query_id JOIN n c ON c.vec_id = document_id),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM near QUALIFY rank <= 5)"""


def _approximate(spark, folder):
    return retrieval.approx_search(vector_queries(spark, folder), vector_chunks(spark, folder), 5)


@query("lsh_topk", f"WITH {LISTS_SQL} SELECT query_id, rank, document_id, round(score, 6) AS score FROM found")
def lsh_topk(spark, folder):
    return _approximate(spark, folder).select("query_id", "rank", "document_id", F.round("score", 6).alias("score"))


@query(
    "lsh_recall",
    f"""WITH {LISTS_SQL}, x AS (WITH {COSINE_HITS_SQL} SELECT query_id, document_id FROM hits)
SELECT x.query_id, round(count(f.document_id) / 5.0::DOUBLE, 6) AS recall FROM x LEFT JOIN found f
 ON x.query_id = f.query_id AND x.document_id = f.document_id GROUP BY x.query_id""",
)
def lsh_recall(spark, folder):
    queries, chunks = vector_queries(spark, folder), vector_chunks(spark, folder)
    exact = nearest(queries.withColumn("top_k", F.lit(5)), chunks, retrieval.CHUNK_KEYS)
    return retrieval.recall_against(exact, _approximate(spark, folder)).select("query_id", F.round("recall", 6).alias("recall"))
