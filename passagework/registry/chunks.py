"""Chunking and embedding."""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.operators import chunking, embedding, provenance, vector_cache
from passagework.registry.base import (
    DOC_PAGES_SQL, LINE_PAGES_SQL, NON_BLANK, document_pages, line_pages, load, query, sql_chunk_tables, sql_hashed,
)
from passagework.session import scratch_path
from passagework.sources.tables import read_committed


@query(
    "non_blank_pages",
    f"WITH {LINE_PAGES_SQL} SELECT document_id, page_number, content FROM pg WHERE regexp_matches(content, '{NON_BLANK}')",
)
def non_blank_pages(spark, folder):
    return chunking.non_blank(line_pages(spark, folder))


@query(
    "chunk_recursive",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}
SELECT document_id, page_number, piece_no, text, CAST(length(text) AS INTEGER) AS token_count FROM ch""",
)
def chunk_recursive(spark, folder):
    return chunking.recursive_chunks(document_pages(spark, folder)).select(
        "document_id", "page_number", "piece_no", "text", "token_count"
    )


@query(
    "chunk_recursive_small",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '40')}
SELECT document_id, piece_no, text, start_index, end_index FROM ch""",
)
def chunk_recursive_small(spark, folder):
    """A size below most sentences, so that the word level and the hard cut are reached."""
    return chunking.recursive_chunks(document_pages(spark, folder), 40).select(
        "document_id", "piece_no", "text", "start_index", "end_index"
    )


@query(
    "chunk_sentence_pack",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '256', patterns=(chunking.SENTENCES_AND_LINES,), cut=False)}
SELECT document_id, piece_no, text FROM ch""",
)
def chunk_sentence_pack(spark, folder):
    return chunking.pack_sentences(document_pages(spark, folder), 256).select("document_id", "piece_no", "text")


@query(
    "chunk_offsets",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '256')}
SELECT document_id, page_number, start_index, end_index, true AS exact FROM ch""",
)
def chunk_offsets(spark, folder):
    pages = document_pages(spark, folder)
    chunks = chunking.recursive_chunks(pages.withColumn("page", F.col("content")), 256)
    cut = F.substring("page", F.col("start_index") + 1, F.col("end_index") - F.col("start_index"))
    return chunks.select("document_id", "page_number", "start_index", "end_index", (cut == F.col("text")).alias("exact"))


@query(
    "chunk_ordinals",
    f"""WITH {LINE_PAGES_SQL}, {sql_chunk_tables('pg', '256')}
SELECT document_id, page_number, start_index,
 CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, start_index) - 1 AS INTEGER) AS chunk_index FROM ch""",
)
def chunk_ordinals(spark, folder):
    chunks = chunking.numbered_chunks(line_pages(spark, folder), 256)
    return chunks.select("document_id", "page_number", "start_index", "chunk_index")


@query(
    "token_count_character",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}
SELECT document_id, piece_no, CAST(length(text) AS INTEGER) AS token_count FROM ch""",
)
def token_count_character(spark, folder):
    chunks = chunking.recursive_chunks(document_pages(spark, folder)).drop("token_count")
    return embedding.token_counts(chunks, "character").select("document_id", "piece_no", "token_count")


@query("token_count_bpe")
def token_count_bpe(spark, folder):
    chunks = chunking.recursive_chunks(document_pages(spark, folder))
    return embedding.token_counts(chunks, "gpt2").select("document_id", "piece_no", "token_count")


@query("chunk_by_tokens")
def chunk_by_tokens(spark, folder):
    """Sizes in BPE tokens; no SQL knows the vocabulary, so tests check this against a brute-force statement."""
    return chunking.recursive_chunks(document_pages(spark, folder), 128, tokenizer="gpt2").select(
        "document_id", "piece_no", "text", "token_count", "start_index", "end_index"
    )


@query(
    "chunk_metadata",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048', keep=', lang, source')}
SELECT document_id, piece_no, '{{"embedding_model":"hashing","end_index":' || end_index || ',"lang":"' || lang
 || '","page_number":' || page_number || ',"source":"' || source || '","start_index":' || start_index || '}}' AS metadata FROM ch""",
)
def chunk_metadata(spark, folder):
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("page_number"), F.lit("replaced"))
    pages = document_pages(spark, folder).withColumn("page_meta", meta)
    chunks = chunking.recursive_chunks(pages).withColumn("embedding_model", F.lit("hashing"))
    return provenance.chunk_metadata(chunks).select("document_id", "piece_no", "metadata")


CONFIG_ROWS = [
    ("a", "English", "recursive", "character", 512, 24),
    ("b", "German", "recursive", "character", 1024, None),
    ("c", "English", "recursive", None, None, None),
    ("d", "French", "semantic", "character", 512, 24),
    ("e", "French", "recursive", "words", 512, 24),
]


@query(
    "chunk_config_matrix",
    f"""WITH named AS (SELECT doc_id AS document_id, 1 AS page_number, text AS content,
  CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'French' END AS parser FROM documents),
pg1 AS (SELECT * FROM named WHERE parser = 'English'), pg2 AS (SELECT * FROM named WHERE parser = 'German'),
{sql_chunk_tables('pg1', '512', prefix='a_')}, {sql_chunk_tables('pg2', '1024', prefix='b_')}, {sql_chunk_tables('pg1', '2048', prefix='c_')},
u AS (SELECT 'a' AS config_hash, * FROM a_ch UNION ALL SELECT 'b', * FROM b_ch UNION ALL SELECT 'c', * FROM c_ch)
SELECT config_hash, document_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS tokens, NULL AS reason
FROM u GROUP BY config_hash, document_id
UNION ALL SELECT 'd', NULL, NULL, NULL, 'chunking method is not recursive' UNION ALL SELECT 'e', NULL, NULL, NULL, 'unknown tokenizer'""",
)
def chunk_config_matrix(spark, folder):
    configs = spark.createDataFrame(
        CONFIG_ROWS,
        "config_hash string, parser string, chunking_method string, tokenizer string, chunk_size int, min_characters_per_chunk int",
    )
    parser = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise("French")
    pages = document_pages(spark, folder).withColumn("parser", parser)
    chunks, refused = chunking.chunk_with_configs(pages, configs)
    per_document = chunks.groupBy("config_hash", "document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.lit(None).cast("string").alias("reason")
    )
    none = F.lit(None).cast("bigint")
    return per_document.unionByName(
        refused.select("config_hash", none.alias("document_id"), none.alias("chunks"), none.alias("tokens"), "reason")
    )


@query("docs_without_chunks", "SELECT doc_id AS document_id, source FROM documents WHERE lang = 'es'")
def docs_without_chunks(spark, folder):
    """Spanish texts are blanked out first, character by character, so that they give no chunk."""
    blanked = F.when(F.col("lang") == "es", F.regexp_replace("content", r"\S", " ")).otherwise(F.col("content"))
    pages = document_pages(spark, folder).withColumn("content", blanked)
    return chunking.unchunked(pages, chunking.recursive_chunks(pages)).select("document_id", "source")


@query(
    "embed_batches",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '256')}
SELECT document_id, CAST(piece_no // 16 AS INTEGER) AS batch_no, count(*) AS inputs, max(piece_no % 16) AS last_pos,
 min(piece_no) AS first_index FROM ch GROUP BY document_id, piece_no // 16""",
)
def embed_batches(spark, folder):
    chunks = chunking.number_chunks(chunking.recursive_chunks(document_pages(spark, folder), 256))
    return embedding.assign_batches(chunks, 16).groupBy("document_id", "batch_no").agg(
        F.count(F.lit(1)).alias("inputs"), F.max("batch_pos").alias("last_pos"), F.min("chunk_index").alias("first_index")
    )


@query(
    "hash_embedding",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}, {sql_hashed('ch', 'document_id, piece_no', 64, 'h')}
SELECT document_id, piece_no, CAST(b AS INTEGER) AS dimension, w AS weight FROM h""",
)
def hash_embedding(spark, folder):
    chunks = chunking.recursive_chunks(document_pages(spark, folder)).select("document_id", "piece_no", "text")
    embedded = embedding.embed_chunks(chunks, embedding.hashing_provider(64), "hashing-64").drop("text")
    long = embedded.select("document_id", "piece_no", F.posexplode("embedding").alias("dimension", "v"))
    return long.filter("v <> 0").select("document_id", "piece_no", "dimension", F.col("v").cast("bigint").alias("weight"))


@query(
    "embedding_cache",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}, {sql_hashed('ch', 'document_id, piece_no', 64, 'h')},
n AS (SELECT count(DISTINCT text) AS asked FROM ch)
SELECT document_id, piece_no, CAST(b AS INTEGER) AS dimension, w AS weight, asked, 0::BIGINT AS asked_again FROM h, n""",
)
def embedding_cache(spark, folder):
    """Chunks are embedded twice through a vector cache: copies are asked for once, and the second time nothing is."""
    path, provider = scratch_path(spark, "vectors"), embedding.hashing_provider(64)
    chunks = chunking.recursive_chunks(document_pages(spark, folder)).select("document_id", "piece_no", "text")
    for batch in ("first", "second"):
        embedded = vector_cache.embed_cached(chunks, provider, "hashing-64", path, batch)
    held = read_committed(spark, path, "vectors", vector_cache.VECTORS)
    counts = held.agg(*[F.count(F.when(F.col("batch") == b, 1)).alias(n) for b, n in (("first", "asked"), ("second", "asked_again"))])
    long = embedded.select("document_id", "piece_no", F.posexplode("embedding").alias("dimension", "v")).filter("v <> 0")
    return long.select("document_id", "piece_no", "dimension", F.col("v").cast("bigint").alias("weight")).join(F.broadcast(counts))


@query(
    "vector_dim_check",
    """SELECT vec_id, CASE label WHEN 3 THEN 'vector has another width' WHEN 5 THEN 'vector is null'
 WHEN 7 THEN 'vector has a null element' END AS reason FROM embeddings""",
)
def vector_dim_check(spark, folder):
    """Vectors of three labels are damaged first: cut short, removed, given a null element."""
    v = F.col("embedding")
    damaged = (
        F.when(F.col("label") == 3, F.slice(v, 1, 63))
        .when(F.col("label") == 7, F.concat(F.slice(v, 1, 63), F.array(F.lit(None).cast("float"))))
        .when(F.col("label") != 5, v)
    )
    rows = load(spark, folder, "embeddings").withColumn("embedding", damaged)
    good, bad = embedding.check_vectors(rows, 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("vec_id", "reason"))


@query(
    "l2_normalize",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
SELECT vec_id, CASE WHEN norm > 0 THEN round(v[1] / norm, 6) END AS first_component,
 CASE WHEN norm > 0 THEN round(list_sum(list_transform(v, lambda x: (x / norm) * (x / norm))), 6) END AS squared_norm FROM n""",
)
def l2_normalize(spark, folder):
    """Vectors are scaled by their label first; label 0 gives zero vectors."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    rows = load(spark, folder, "embeddings").select("vec_id", V.l2_normalize(scaled).alias("unit"))
    return rows.select(
        "vec_id", F.round(F.col("unit")[0], 6).alias("first_component"),
        F.round(V.inner_product(F.col("unit"), F.col("unit")), 6).alias("squared_norm"),
    )


@query(
    "embedding_preview",
    """SELECT vec_id, replace(substring(text, 1, 60), chr(10), ' ') AS preview, CAST(len(embedding) AS INTEGER) AS dim,
 round(embedding[1]::DOUBLE, 4) AS first_component, round(embedding[2]::DOUBLE, 4) AS second_component
FROM embeddings JOIN documents ON vec_id = doc_id""",
)
def embedding_preview(spark, folder):
    rows = load(spark, folder, "embeddings").join(
        load(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id"
    )
    return embedding.embedding_preview(rows).select("vec_id", "preview", "dim", "first_component", "second_component")
