"""Sources, markup and pages."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from passagework.functions import metadata as M
from passagework.functions import vectors as V
from passagework.operators import chunking, pages
from passagework.registry.base import (
    DOC_PAGES_SQL, LINE_PAGES_SQL, document_pages, line_pages, load, query, sql_chunk_tables,
)
from passagework.plans.stage import stage
from passagework.session import scratch_path
from passagework.sources import evalset, files, markup, tables

# Documents get a file name whose extension follows their language.
URI_SQL = (
    "'file:///corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.PDF'"
    " WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.html' ELSE '' END"
)


def document_files(spark, folder):
    """uri, content BINARY and the source columns of every document."""
    ext = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "de", ".docx").when(F.col("lang") == "fr", ".html")
    uri = F.concat(F.lit("file:///corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.coalesce(ext, F.lit("")))
    docs = load(spark, folder, "documents")
    return docs.select("doc_id", uri.alias("uri"), F.encode("text", "UTF-8").alias("content"), "text", "lang", "source")


@query(
    "file_discovery",
    "SELECT lang, source, CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes FROM documents GROUP BY lang, source",
)
def file_discovery(spark, folder):
    path = scratch_path(spark, "files")
    docs = load(spark, folder, "documents").select("text", "lang", "source")
    docs.write.partitionBy("lang", "source").text(path)
    found = files.require_files(files.discover_files(spark, path, (".txt",)), path, (".txt",))
    part = [F.regexp_extract("uri", f"/{p}=([^/]*)/", 1).alias(p) for p in ("lang", "source")]
    return found.select(*part, "byte_size").groupBy("lang", "source").agg(F.sum("byte_size").alias("total_bytes"))


@query(
    "file_facts",
    f"""WITH f AS (SELECT {URI_SQL} AS uri, text, lang FROM documents)
SELECT uri, string_split(uri, '/')[-1] AS file_name,
 CASE lang WHEN 'en' THEN 'application/pdf'
  WHEN 'de' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  WHEN 'fr' THEN 'text/html' END AS mime_type,
 strlen(text) AS byte_size, sha256(text) AS content_hash FROM f""",
)
def file_facts(spark, folder):
    return files.file_facts(document_files(spark, folder).select("uri", "content"))


HANDLERS = [markup.WORD_HANDLER, files.Handler("FirstPdf", "2", ("PDF",)), files.Handler("SecondPdf", "1", ("PDF", "DOCX"))]
WITH_HTML = {**files.FILE_TYPES, "html": "HTML"}


@query(
    "format_routing",
    f"""WITH f AS (SELECT {URI_SQL} AS uri FROM documents UNION ALL SELECT url FROM pages),
t AS (SELECT uri, lower(regexp_extract(string_split(uri, '/')[-1], '(?s)[^.].*\\.([^.]*)$', 1)) AS ext FROM f)
SELECT uri, CASE ext WHEN 'pdf' THEN 'PDF' WHEN 'docx' THEN 'DOCX' WHEN 'html' THEN 'HTML' END AS file_type,
 CASE ext WHEN 'pdf' THEN 'FirstPdf' WHEN 'docx' THEN 'WordHandler' END AS parser,
 CASE WHEN ext = 'html' THEN 'no handler registered for file type'
  WHEN ext NOT IN ('pdf', 'docx') THEN 'unsupported file extension' END AS reason
FROM t""",
)
def format_routing(spark, folder):
    named = document_files(spark, folder).select("uri").unionByName(load(spark, folder, "pages").select(F.col("url").alias("uri")))
    good, bad = files.route_formats(named, files.handler_table(spark, HANDLERS), WITH_HTML)
    columns = ["uri", "file_type", "parser", "reason"]
    return good.withColumn("reason", F.lit(None).cast("string")).select(columns).unionByName(
        bad.withColumn("parser", F.lit(None).cast("string")).select(columns)
    )


@query(
    "eval_set_load",
    """SELECT CASE WHEN ok THEN question END AS user_input, CASE WHEN ok THEN text END AS reference,
 CASE WHEN NOT ok THEN 'sample has keys: user_input' END AS reason
FROM (SELECT text, regexp_extract(text, '^[^.!?]*[.!?]?') AS question, NOT contains(text, chr(10)) AS ok FROM benchmark)""",
)
def eval_set_load(spark, folder):
    path = scratch_path(spark, "evalset")
    items = load(spark, folder, "benchmark")
    # Items with a line break are written without a reference: to_json leaves a null field out.
    sample = F.to_json(
        F.struct(
            F.regexp_extract("text", "^[^.!?]*[.!?]?", 0).alias("user_input"),
            F.when(~F.col("text").contains("\n"), F.col("text")).alias("reference"),
        )
    )
    lists = items.groupBy(F.floor(F.col("item_id") / 20).alias("part")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(sample), ","), F.lit("]")).alias("value")
    )
    lists.write.partitionBy("part").text(path)
    good, bad = evalset.read_samples(spark, path)
    none = F.lit(None).cast("string")
    return good.withColumn("reason", none).unionByName(
        bad.select(none.alias("user_input"), none.alias("reference"), "reason")
    )


@query(
    "table_roundtrip",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048', keep=', lang')}
SELECT sha256(lang) AS extraction_config_hash, count(DISTINCT document_id) AS documents, count(*) AS chunks,
 CAST(sum(length(text)) AS BIGINT) AS tokens FROM ch GROUP BY lang""",
)
def table_roundtrip(spark, folder):
    path = scratch_path(spark, "tables")
    docs = document_pages(spark, folder)
    chunks = chunking.recursive_chunks(docs).withColumn("extraction_config_hash", F.sha2("lang", 256))
    configs = docs.select(F.sha2("lang", 256).alias("config_hash"), F.col("lang").alias("config")).distinct()
    tables.write_tables(configs, docs.drop("content"), chunks, path)
    from passagework.operators.provenance import config_inventory

    stored = tables.read_table(spark, path, "chunks")
    known = tables.read_table(spark, path, "documents").select("document_id")
    used = tables.read_table(spark, path, "extraction_configs").select(F.col("config_hash").alias("extraction_config_hash"))
    return config_inventory(
        stored.join(known, "document_id", "left_semi").join(used, "extraction_config_hash", "left_semi")
    )


@query(
    "table_lifecycle",
    f"""SELECT 'kept' AS state, false AS dropped, {URI_SQL} AS uri FROM documents
UNION ALL SELECT 'anew', true, {URI_SQL} FROM documents WHERE doc_id % 2 = 0""",
)
def table_lifecycle(spark, folder):
    """Tables are made, filled and kept by a second start; a third one drops them, and half of the documents go in anew."""
    prefix = f"t{uuid.uuid4().hex}_"

    def fill(rows):
        files.file_facts(rows).select(
            F.sha2("uri", 256).alias("id"), "uri", "file_name", "mime_type", "byte_size", "content_hash",
            F.lit("{}").alias("metadata"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
        ).write.insertInto(f"{prefix}documents")

    def state(name, dropped):
        return spark.table(f"{prefix}documents").select(F.lit(name).alias("state"), F.lit(dropped).alias("dropped"), "uri")

    place = scratch_path(spark, "lifecycle")
    tables.reset_tables(spark, prefix, place)
    fill(document_files(spark, folder))
    kept = stage(state("kept", tables.reset_tables(spark, prefix, place)), "kept")
    dropped = tables.reset_tables(spark, prefix, scratch_path(spark, "lifecycle"), overwrite=True)
    fill(document_files(spark, folder).filter("doc_id % 2 = 0"))
    return kept.unionByName(state("anew", dropped))


@query(
    "vector_text_roundtrip",
    """SELECT vec_id, len(embedding) AS dim, 0.0::DOUBLE AS drift,
 round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""",
)
def vector_text_roundtrip(spark, folder):
    text = load(spark, folder, "embeddings").withColumn("t", V.vector_to_text(F.col("embedding")))
    back = text.withColumn("v", V.vector_from_text(F.col("t")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select(
        "vec_id", F.size("v").cast("bigint").alias("dim"), V.l2_distance(F.col("v"), F.col("embedding")).alias("drift"),
        F.round(total, 6).alias("total"),
    )


EVENTS_SQL = f"""pieces AS (SELECT page_id,
  regexp_extract_all(regexp_replace(html, '{markup.HTML_HIDDEN}', '', 'g'), '{markup.HTML_PIECE}') AS ps FROM pages),
nested AS (SELECT page_id, flatten(list_transform(ps, lambda p: CASE WHEN regexp_matches(p, '{markup.HTML_PAGE}')
   THEN [{{'kind': 'text', 'text': regexp_replace(p, '{markup.HTML_TAG}', '', 'g')}}, {{'kind': 'break', 'text': ''}}]
   ELSE [{{'kind': 'text', 'text': regexp_replace(p, '{markup.HTML_TAG}', '', 'g')}}] END)) AS es FROM pieces),
ev AS (SELECT page_id, CAST(generate_subscripts(es, 1) - 1 AS INTEGER) AS seq, unnest(es, recursive := true) FROM nested)"""


@query("markup_events", f"WITH {EVENTS_SQL} SELECT page_id, seq, kind, text FROM ev")
def markup_events(spark, folder):
    return markup.markup_events(load(spark, folder, "pages"), "page_id", "html", "html")


PAGES_SQL = f"""{EVENTS_SQL},
raw AS (SELECT *, sum(CASE kind WHEN 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY seq) AS raw_page FROM ev),
filled AS (SELECT page_id, raw_page, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS content FROM raw
  WHERE kind = 'text' AND regexp_matches(text, '[^ \\t\\n\\r\\f\\x0B\\x{{A0}}]') GROUP BY page_id, raw_page),
assembled AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY raw_page) AS INTEGER) AS page_number, content
  FROM filled UNION ALL SELECT page_id, 1, '' FROM pages WHERE page_id NOT IN (SELECT page_id FROM filled))"""


@query("page_assembly", f"WITH {PAGES_SQL} SELECT page_id, page_number, content FROM assembled")
def page_assembly(spark, folder):
    return pages.numbered_pages(load(spark, folder, "pages"), "page_id", markup.DIALECTS["html"](F.col("html")))


@query("physical_pages", f"WITH {LINE_PAGES_SQL} SELECT document_id, page_number, content FROM pg")
def physical_pages(spark, folder):
    return line_pages(spark, folder)


@query(
    "table_row_text",
    f"WITH {LINE_PAGES_SQL} SELECT document_id, page_number AS row_no, replace(content, ' ', chr(9)) AS text FROM pg",
)
def table_row_text(spark, folder):
    lines = line_pages(spark, folder).withColumnRenamed("page_number", "row_no")
    cells = lines.select("document_id", "row_no", F.posexplode(F.split("content", " ")).alias("cell_no", "text"))
    return pages.table_row_text(cells, "document_id")


@query("flat_content", "SELECT doc_id AS document_id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents")
def flat_content(spark, folder):
    return pages.flat_content(line_pages(spark, folder), "document_id")


@query("page_count", f"WITH {LINE_PAGES_SQL} SELECT document_id, count(*) AS page_count FROM pg GROUP BY document_id")
def page_count(spark, folder):
    return pages.page_count(line_pages(spark, folder), "document_id")


@query(
    "title_fallback",
    """SELECT page_id, coalesce(nullif(CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END, ''),
  string_split(url, '/')[-1]) AS title,
 '' AS author, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created,
 '' AS modified FROM pages""",
)
def title_fallback(spark, folder):
    # Every fifth page loses its title, so that the fallback is used too.
    html = load(spark, folder, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 != 0, F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"),
        files.file_name(F.col("url")).alias("file_name"),
        F.lit(None).cast("string").alias("author"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("created"),
        F.lit(None).cast("timestamp").alias("modified"),
    )
    return pages.doc_metadata(html).drop("file_name")


@query(
    "metadata_merge",
    """SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '","title":"' || lang || '-' || doc_id || '"}' AS metadata
FROM documents""",
)
def metadata_merge(spark, folder):
    left = F.create_map(F.lit("title"), F.lit("replaced"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    right = F.create_map(F.lit("title"), F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")))
    merged = M.metadata_text(M.merge_metadata(left, right))
    return load(spark, folder, "documents").select("doc_id", merged.alias("metadata"))


@query(
    "document_profile",
    f"""WITH {LINE_PAGES_SQL}, s AS (SELECT document_id, count(*) AS page_count,
  CAST(sum(length(content)) + 2 * (count(*) - 1) AS BIGINT) AS total_chars FROM pg GROUP BY document_id)
SELECT document_id, strlen(text) AS byte_size, CASE lang WHEN 'en' THEN 'PDF' WHEN 'de' THEN 'DOCX' END AS file_type,
 string_split({URI_SQL}, '/')[-1] AS title, '{{"lang":"' || lang || '"}}' AS metadata, page_count, total_chars
FROM documents JOIN s ON doc_id = document_id""",
)
def document_profile(spark, folder):
    docs = document_files(spark, folder)
    name = files.file_name(F.col("uri"))
    facts = docs.select(
        F.col("doc_id").alias("document_id"),
        F.octet_length("text").cast("bigint").alias("byte_size"),
        files.file_type(name).alias("file_type"),
        pages.title_or_name(F.lit(""), name).alias("title"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("author"), F.lit(""), F.lit("created"), F.lit(None).cast("string")).alias("metadata"),
    )
    profile = pages.profile_documents(facts, line_pages(spark, folder), "document_id")
    return profile.withColumn("metadata", M.metadata_text(F.col("metadata")))


@query(
    "page_preview",
    """SELECT doc_id, length(text) AS page_chars, CASE WHEN length(text) > 1200
 THEN substring(text, 1, 1200) || '  … (+' || format('{:,}', length(text) - 1200) || ' more chars)' ELSE text END AS preview
FROM documents""",
)
def page_preview(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return pages.preview_pages(docs).select("doc_id", F.col("page_chars").cast("bigint"), "preview")
