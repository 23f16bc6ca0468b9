"""Provenance, idempotent writes and audits.

Stored state is derived from whole tables: the store holds all documents and all benchmark texts; the incoming sources are
all documents, the German ones with changed text, and all web pages. So sources are unchanged, changed, new and gone.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions.text import join_ordered
from passagework.operators import chunking, embedding, ingest, provenance, retrieval
from passagework.registry.base import DOC_PAGES_SQL, document_pages, load, query, sql_chunk_tables, sql_hashed_topk
from passagework.registry.ingest import HANDLERS, PAGES_SQL, WITH_HTML, document_files
from passagework.plans.nearest import MAX_BROADCAST_HITS
from passagework.plans.stage import remove, stage
from passagework.session import scratch_path
from passagework.sources import files, markup, tables

STORED_AT, NOW = "2024-01-01 00:00:00", "2024-06-01 00:00:00"
CHANGED_SQL = "CASE WHEN lang = 'de' THEN text || chr(10) || 'Neu. ' || text ELSE text END"
SOURCES_SQL = f"""stored AS (SELECT 'doc/' || doc_id AS uri, text FROM documents UNION ALL SELECT 'bench/' || item_id, text FROM benchmark),
incoming AS (SELECT 'doc/' || doc_id AS uri, {CHANGED_SQL} AS text FROM documents UNION ALL SELECT url, html FROM pages)"""


def _changed():
    text = F.col("text")
    return F.when(F.col("lang") == "de", F.concat(text, F.lit("\nNeu. "), text)).otherwise(text)


def _facts(rows, *keep):
    facts = files.file_facts(rows.select("*", F.encode("text", "UTF-8").alias("content")), *keep)
    return facts.withColumn("metadata", F.lit("{}"))


def _uri(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string")).alias("uri")


def stored_sources(spark, folder):
    docs = load(spark, folder, "documents").select(_uri("doc/", "doc_id"), "text")
    return docs.unionByName(load(spark, folder, "benchmark").select(_uri("bench/", "item_id"), "text"))


def incoming_sources(spark, folder):
    docs = load(spark, folder, "documents").select(_uri("doc/", "doc_id"), _changed().alias("text"))
    return docs.unionByName(load(spark, folder, "pages").select(F.col("url").alias("uri"), F.col("html").alias("text")))


def stored_documents(spark, folder):
    at = F.lit(STORED_AT).cast("timestamp")
    return _facts(stored_sources(spark, folder)).select(
        provenance.document_id(F.col("uri")).alias("id"), "*", at.alias("created_at"), at.alias("updated_at")
    )


FINGERPRINT_SQL = """'{"chonkie_ver":"1.0","chunking_method":"recursive","chunking_method_params":{"chunk_size":' || size
 || ',"min_characters_per_chunk":24,"note":"é"},"embedding_model":"hashing","embedding_provider":"local","embedding_size":'
 || size || ',"parser":"' || lang || '","parser_params":{},"parser_ver":"' || source || '","tokenizer":"character"}'"""


def _config_rows(groups):
    """Config columns of rows (lang, source, size): the parameters arrive as JSON text with unordered keys and blanks."""
    params = F.concat(
        F.lit('{"note": "é", "min_characters_per_chunk": 24,  "chunk_size": '), F.col("size").cast("string"), F.lit("}")
    )
    return groups.select(
        F.lit("1.0").alias("chonkie_ver"), F.lit("recursive").alias("chunking_method"), params.alias("chunking_method_params"),
        F.lit("hashing").alias("embedding_model"), F.lit("local").alias("embedding_provider"), F.col("size").alias("embedding_size"),
        F.col("lang").alias("parser"), F.lit("{}").alias("parser_params"), F.col("source").alias("parser_ver"),
        F.lit("character").alias("tokenizer"),
    )


def _groups(spark, folder):
    return load(spark, folder, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("size"))


GROUPS_SQL = "g AS (SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY lang, source)"


@query(
    "config_fingerprint",
    f"WITH {GROUPS_SQL}, c AS (SELECT {FINGERPRINT_SQL} AS config FROM g) SELECT config, sha256(config) AS config_hash FROM c",
)
def config_fingerprint(spark, folder):
    return provenance.fingerprint(_config_rows(_groups(spark, folder))).select("config", "config_hash")


@query(
    "config_per_format",
    """WITH h AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'FirstPdf' ELSE 'WordHandler' END AS parser,
  CASE lang WHEN 'en' THEN '2' ELSE '1' END AS ver FROM documents WHERE lang IN ('en', 'de')),
r AS (SELECT unnest([256, 512]) AS size),
c AS (SELECT parser, size, '{"chonkie_ver":"1.0","chunking_method":"recursive","chunking_method_params":{"chunk_size":' || size
 || '},"embedding_model":"hashing","embedding_provider":"local","embedding_size":64,"parser":"' || parser
 || '","parser_params":{},"parser_ver":"' || ver || '","tokenizer":"character"}' AS config FROM h, r)
SELECT parser, config, sha256(config) AS config_hash FROM c""",
)
def config_per_format(spark, folder):
    routed, _ = files.route_formats(document_files(spark, folder).select("uri"), files.handler_table(spark, HANDLERS), WITH_HTML)
    runs = spark.createDataFrame(
        [("1.0", "recursive", f'{{"chunk_size": {n}}}', "hashing", "local", 64, "character") for n in (256, 512)],
        "chonkie_ver string, chunking_method string, chunking_method_params string, embedding_model string, "
        "embedding_provider string, embedding_size int, tokenizer string",
    )
    return provenance.derive_configs(routed, runs).select("parser", "config", "config_hash")


@query(
    "config_insert",
    f"""WITH {GROUPS_SQL}, c AS (SELECT lang, sha256({FINGERPRINT_SQL}) AS config_hash FROM g)
SELECT config_hash, CASE lang WHEN 'en' THEN '{STORED_AT}' ELSE '{NOW}' END AS created_at FROM c""",
)
def config_insert(spark, folder):
    """English configs are stored already; all configs arrive, each of them twice."""
    groups = _groups(spark, folder)

    def rows(part, at):
        return provenance.fingerprint(_config_rows(part)).select(
            "config_hash", "config", F.lit(at).cast("timestamp").alias("created_at")
        )

    new = rows(groups, NOW)
    merged = provenance.insert_configs(rows(groups.filter("lang = 'en'"), STORED_AT), new.unionByName(new))
    return merged.select("config_hash", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(
    "document_upsert",
    f"""WITH {SOURCES_SQL}, last AS (SELECT uri, max(text) AS text FROM incoming GROUP BY uri)
SELECT sha256(coalesce(s.uri, i.uri)) AS id, coalesce(s.uri, i.uri) AS uri,
 string_split(coalesce(s.uri, i.uri), '/')[-1] AS file_name, strlen(coalesce(i.text, s.text)) AS byte_size,
 sha256(coalesce(i.text, s.text)) AS content_hash,
 CASE WHEN s.uri IS NULL THEN '{NOW}' ELSE '{STORED_AT}' END AS created_at,
 CASE WHEN i.uri IS NULL THEN '{STORED_AT}' ELSE '{NOW}' END AS updated_at
FROM stored s FULL OUTER JOIN last i ON s.uri = i.uri""",
)
def document_upsert(spark, folder):
    """A page address met twice is written twice; the last write (largest text) counts."""
    incoming, now = _facts(incoming_sources(spark, folder), "text"), F.lit(NOW).cast("timestamp")
    merged = provenance.upsert_documents(stored_documents(spark, folder), incoming, now, [F.col("text")])
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at")]
    return merged.select("id", "uri", "file_name", "byte_size", "content_hash", *stamp)


def chunk_rows(spark, folder, changed, config, size=2048):
    """Stored-form chunks of all documents, as they are or with the German ones changed."""
    pages = load(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"),
        (_changed() if changed else F.col("text")).alias("content"),
    )
    return chunking.recursive_chunks(pages, size).select(
        "document_id", F.col("piece_no").alias("chunk_index"), F.lit(config).alias("extraction_config_hash"),
        F.col("text").alias("content"), "token_count",
    )


VERSIONS_SQL = f"""old_pg AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, text AS content FROM documents),
new_pg AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, {CHANGED_SQL} AS content FROM documents),
{sql_chunk_tables('old_pg', '2048', prefix='o_')}, {sql_chunk_tables('new_pg', '2048', prefix='n_')}"""


@query(
    "chunk_insert_only",
    f"""WITH {VERSIONS_SQL}
SELECT document_id, piece_no AS chunk_index, 'one' AS extraction_config_hash, text AS content FROM n_ch n
 WHERE NOT EXISTS (SELECT 1 FROM o_ch o WHERE o.document_id = n.document_id AND o.piece_no = n.piece_no)
UNION ALL SELECT document_id, piece_no, 'two', text FROM o_ch""",
)
def chunk_insert_only(spark, folder):
    """What a write adds: the changed texts' extra chunks under the known config and every chunk of a new config, each once."""
    known = chunk_rows(spark, folder, False, "one")
    again = chunk_rows(spark, folder, True, "one")
    batch = again.unionByName(again).unionByName(chunk_rows(spark, folder, False, "two"))
    return provenance.new_chunks(known, batch).select(*provenance.CHUNK_KEY, "content")


@query(
    "ingest_report",
    f"""WITH {VERSIONS_SQL},
offered AS (SELECT document_id, count(*) AS embedded FROM n_ch GROUP BY document_id),
written AS (SELECT document_id, count(*) AS inserted FROM n_ch n
 WHERE NOT EXISTS (SELECT 1 FROM o_ch o WHERE o.document_id = n.document_id AND o.piece_no = n.piece_no) GROUP BY document_id),
r AS (SELECT document_id || '.txt' AS file_name, embedded, coalesce(inserted, 0) AS inserted FROM offered LEFT JOIN written USING (document_id))
SELECT file_name, CAST(sum(embedded) AS BIGINT) AS embedded, CAST(sum(inserted) AS BIGINT) AS inserted FROM r GROUP BY ROLLUP (file_name)""",
)
def ingest_report(spark, folder):
    ids = load(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"))
    documents = ids.withColumn("file_name", F.concat("id", F.lit(".txt")))
    return provenance.ingest_report(documents, chunk_rows(spark, folder, False, "one"), chunk_rows(spark, folder, True, "one"))


@query(
    "atomic_batch",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048', keep=', lang')}
SELECT lang, CAST(count(DISTINCT document_id) AS BIGINT) AS documents, count(*) AS chunks FROM ch WHERE lang IN ('en', 'de') GROUP BY lang""",
)
def atomic_batch(spark, folder):
    """One committed batch per language; the last one is left without its marker and must not show."""
    path = scratch_path(spark, "batches")
    docs = document_pages(spark, folder)
    chunks = chunking.recursive_chunks(docs).select("document_id", "piece_no", "lang")
    for lang in ("en", "de"):
        for _ in range(2):  # a repeated batch changes nothing
            tables.commit_batch(
                path,
                {"documents": docs.select("document_id", "lang").filter(F.col("lang") == lang), "chunks": chunks.filter(F.col("lang") == lang)},
                lang,
            )
    rest = docs.select("document_id", "lang").filter(~F.col("lang").isin("en", "de"))
    rest.write.parquet(f"{path}/documents/batch=rest")
    seen = tables.read_committed(spark, path, "documents", "document_id bigint, lang string").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents")
    )
    held = tables.read_committed(spark, path, "chunks", "document_id bigint, piece_no int, lang string").groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks")
    )
    return seen.join(held, "lang")


def _audit_chunks(spark, folder):
    return document_pages(spark, folder).select(
        "document_id", F.lit(0).alias("chunk_index"), F.col("source").alias("extraction_config_hash"), "content", "lang"
    )


@query(
    "fk_violations",
    """SELECT doc_id AS document_id, 0 AS chunk_index, source AS extraction_config_hash, 'document' AS violation FROM documents WHERE lang = 'es'
UNION ALL SELECT doc_id, 0, source, 'config' FROM documents WHERE source = 'src3'""",
)
def fk_violations(spark, folder):
    """Spanish documents are missing from the document table and one source from the config table."""
    docs = load(spark, folder, "documents")
    return provenance.fk_violations(
        _audit_chunks(spark, folder),
        docs.filter("lang <> 'es'").select(F.col("doc_id").alias("id")),
        docs.filter("source <> 'src3'").select(F.col("source").alias("config_hash")).distinct(),
    )


@query(
    "key_violations",
    """SELECT 'duplicate key' AS violation, CAST(doc_id AS VARCHAR) || '|0|' || source AS detail, 2::BIGINT AS rows FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'null value', 'content', n FROM (SELECT sum(CASE WHEN lang = 'fr' THEN 2 ELSE 1 END)::BIGINT AS n FROM documents WHERE source = 'src3') WHERE n > 0""",
)
def key_violations(spark, folder):
    """French chunks are stored twice and the contents of one source are lost."""
    rows = _audit_chunks(spark, folder).withColumn("content", F.when(F.col("extraction_config_hash") != "src3", F.col("content")))
    stored = rows.unionByName(rows.filter("lang = 'fr'"))
    return provenance.key_violations(stored, provenance.CHUNK_KEY, ["document_id", "chunk_index", "content"])


@query(
    "cascade_delete",
    """WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'document' AS kind, doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunk', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def cascade_delete(spark, folder):
    gone = load(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    left, kept = provenance.delete_documents(docs, _audit_chunks(spark, folder), gone)
    return left.select(F.lit("document").alias("kind"), F.col("id").alias("document_id")).unionByName(
        kept.select(F.lit("chunk").alias("kind"), "document_id")
    )


@query(
    "chunks_of_document",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '2048')}
SELECT document_id, piece_no, text FROM ch WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY document_id, piece_no""",
)
def chunks_of_document(spark, folder):
    wanted = load(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    chunks = chunking.recursive_chunks(document_pages(spark, folder))
    return provenance.chunks_of(chunks, wanted).select("document_id", "piece_no", "text").orderBy("document_id", "piece_no")


@query(
    "source_diff",
    f"""WITH {SOURCES_SQL}, i AS (SELECT DISTINCT uri, text FROM incoming)
SELECT coalesce(s.uri, i.uri) AS uri, CASE WHEN s.uri IS NULL THEN 'new' WHEN i.uri IS NULL THEN 'gone'
 WHEN s.text = i.text THEN 'unchanged' ELSE 'changed' END AS state FROM stored s FULL OUTER JOIN i ON s.uri = i.uri""",
)
def source_diff(spark, folder):
    incoming = incoming_sources(spark, folder).distinct()
    return provenance.diff_sources(stored_documents(spark, folder), _facts(incoming))


STALE_SQL = f"""WITH {VERSIONS_SQL}
SELECT n.document_id, n.piece_no AS chunk_index, 'one' AS extraction_config_hash,
 CASE WHEN o.text IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM n_ch n LEFT JOIN o_ch o ON n.document_id = o.document_id AND n.piece_no = o.piece_no WHERE n.text IS DISTINCT FROM o.text"""


@query("stale_chunks", STALE_SQL)
def stale_chunks(spark, folder):
    """The store holds the longer German texts; the sources are the original ones."""
    return provenance.stale_chunks(chunk_rows(spark, folder, True, "one"), chunk_rows(spark, folder, False, "one"))


@query("stale_by_digest", STALE_SQL)
def stale_by_digest(spark, folder):
    """As ``stale_chunks``, with chunks and their digests as they were written; equal documents are told by digest."""
    stored = stage(chunk_rows(spark, folder, True, "one"), "stored")
    digests = stage(provenance.chunk_digests(stored), "digests")
    return provenance.stale_chunks(stored, stage(chunk_rows(spark, folder, False, "one"), "current"), digests)


@query(
    "config_inventory",
    f"""WITH {VERSIONS_SQL}, u AS (SELECT 'one' AS extraction_config_hash, * FROM o_ch UNION ALL SELECT 'two', * FROM n_ch)
SELECT extraction_config_hash, count(DISTINCT document_id) AS documents, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS tokens
FROM u GROUP BY extraction_config_hash""",
)
def config_inventory(spark, folder):
    one, two = chunk_rows(spark, folder, False, "one"), chunk_rows(spark, folder, True, "two")
    return provenance.config_inventory(one.unionByName(two))


RUN = ("1.0", "recursive", '{"chunk_size": 256, "min_characters_per_chunk": 24}', "hashing", "local", 64, "character")
RUN_COLUMNS = (
    "chonkie_ver string, chunking_method string, chunking_method_params string, embedding_model string, "
    "embedding_provider string, embedding_size int, tokenizer string"
)
#: Rows whose texts make up one file.
PER_FILE = 16
INGESTED_SQL = f"""WITH web AS (SELECT page_id // {PER_FILE} AS page_id, string_agg(html, chr(10) ORDER BY page_id) AS html FROM pages GROUP BY page_id // {PER_FILE}),
{PAGES_SQL.replace('FROM pages', 'FROM web')},
pg AS (SELECT 'page-' || page_id AS document_id, page_number, content FROM assembled
 UNION ALL SELECT 'doc-' || doc_id // {PER_FILE}, 1, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) FROM documents GROUP BY doc_id // {PER_FILE}),
{sql_chunk_tables('pg', '256')},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, piece_no) - 1 AS INTEGER) AS chunk_index FROM ch)"""


def _write_files(spark, folder):
    """Web pages as HTML files and documents as text files, sixteen neighbours in each; the folder names the file."""
    path = scratch_path(spark, "sources")

    def write(table, key, column, prefix, place):
        row = F.concat(F.lit(prefix), F.floor(F.col(key) / PER_FILE).cast("string")).alias("row")
        texts = load(spark, folder, table).groupBy(row).agg(join_ordered([F.col(key)], F.col(column), "\n").alias("value"))
        texts.write.partitionBy("row").text(f"{path}/{place}")

    write("pages", "page_id", "html", "page-", "html")
    write("documents", "doc_id", "text", "doc-", "txt")
    return path


def _small(names):
    """One narrow row a file: up to the bound of other broadcasts it goes to the chunks, which then stay where they are."""
    names = stage(names, "names")
    return F.broadcast(names) if names.count() <= MAX_BROADCAST_HITS else names


def _plain_pages(rows):
    """Files written by Spark all end in .txt, so the folder says which of the two formats a file has."""
    is_web = F.col("uri").contains("/html/")
    return markup.html_pages(rows.filter(is_web)).unionByName(markup.text_pages(rows.filter(~is_web)))


@query(
    "file_ingest",
    f"""{INGESTED_SQL}
SELECT document_id, chunk_index, page_number, start_index, end_index, text AS content, CAST(length(text) AS INTEGER) AS token_count,
 64 AS dim, 0::BIGINT AS added_again, 0::BIGINT AS violations FROM numbered""",
)
def file_ingest(spark, folder):
    """All files are taken in twice; the second run adds nothing and the audits of the stored tables find nothing."""
    source, store = _write_files(spark, folder), scratch_path(spark, "store")
    handler = files.Handler("PlainHandler", "1", ("TEXT",), _plain_pages)
    runs, now = spark.createDataFrame([RUN], RUN_COLUMNS), F.lit(NOW).cast("timestamp")
    for batch in ("first", "second"):
        report, _ = ingest.ingest_files(
            spark, source, store, batch, [handler], runs, embedding.hashing_provider(64), 64, "hashing", {"txt": "TEXT"}, now, (".txt",)
        )
    chunks, documents = ingest.stored_chunks(spark, store), ingest.current_documents(spark, store)
    broken = provenance.fk_violations(chunks, documents, ingest.stored_configs(spark, store)).select("violation")
    repeated = provenance.key_violations(chunks, provenance.CHUNK_KEY, ["document_id", "content", "metadata", "embedding"]).select("violation")
    audit = broken.unionByName(repeated).agg(F.count(F.lit(1)).alias("violations"))
    again = report.agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("added_again"))
    names = documents.select(F.col("id").alias("document_id"), F.regexp_extract("uri", "/row=([^/]*)/", 1).alias("row"))

    def number(name):
        return F.get_json_object("metadata", f"$.{name}").cast("int").alias(name)

    rows = chunks.join(_small(names), "document_id").select(
        F.col("row").alias("document_id"), "chunk_index", number("page_number"), number("start_index"), number("end_index"), "content", "token_count",
        F.size("embedding").alias("dim"),
    )
    return rows.join(F.broadcast(again)).join(F.broadcast(audit))


@query(
    "store_search",
    f"""{INGESTED_SQL}, items AS (SELECT item_id AS query_id, text FROM benchmark),
filed AS (SELECT document_id, chunk_index, text FROM numbered), {sql_hashed_topk('5', 64, 'items', keys='document_id, chunk_index').replace('FROM ch)', 'FROM filed)')}
SELECT query_id, rank, document_id, chunk_index, round(score, 6) AS score FROM hits""",
)
def store_search(spark, folder):
    """All files are taken in twice, both batches become one, and the store answers the benchmark's texts."""
    source, store = _write_files(spark, folder), scratch_path(spark, "store")
    handler = files.Handler("PlainHandler", "1", ("TEXT",), _plain_pages)
    runs, now = spark.createDataFrame([RUN], RUN_COLUMNS), F.lit(NOW).cast("timestamp")
    provider = embedding.hashing_provider(64)
    for batch in ("first", "second"):
        ingest.ingest_files(spark, source, store, batch, [handler], runs, provider, 64, "hashing", {"txt": "TEXT"}, now, (".txt",))
    remove(spark, source)
    if ingest.compact(spark, store, "compacted"):
        ingest.remove_replaced(spark, store)
    row = F.regexp_extract("uri", "/row=([^/]*)/", 1)
    names = ingest.current_documents(spark, store).select(F.col("id").alias("document_id"), row.alias("row"), "file_name")
    items = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    # Equal scores are ordered by the names that the SQL knows, not by the hashed ids.
    chunks = ingest.stored_chunks(spark, store).join(_small(names), "document_id").withColumn("document_id", F.col("row"))
    hits = retrieval.search(embedding.embed_chunks(items, provider, "hashing"), chunks.select("document_id", "chunk_index", "embedding"), k=5)
    return hits.select("query_id", "rank", "document_id", "chunk_index", F.round("score", 6).alias("score"))
