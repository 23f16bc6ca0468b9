"""Streaming forms. Their final state equals a batch result, so both have SQL to compare with."""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import embedding
from passagework.operators.ingest import current_documents, stored_chunks, stored_configs
from passagework.registry.base import DOC_PAGES_SQL, load, query, sql_chunk_tables
from passagework.registry.store import NOW, RUN, RUN_COLUMNS
from passagework.session import scratch_path
from passagework.sources import files, markup
from passagework.streaming import counter, ingest


@query(
    "stream_ingest",
    f"""WITH {DOC_PAGES_SQL}, {sql_chunk_tables('pg', '256')}
SELECT sha256('doc/' || document_id || '.txt') AS document_id, document_id || '.txt' AS file_name, piece_no AS chunk_index, page_number,
 text AS content, CAST(length(text) AS INTEGER) AS token_count, 1::BIGINT AS configs FROM ch""",
)
def stream_ingest(spark, folder):
    """All documents arrive twice as text files, the second time from a new checkpoint; the second pass must change nothing."""
    src, out = scratch_path(spark, "incoming"), scratch_path(spark, "store")
    uri = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri")
    now = F.lit(NOW).cast("timestamp")
    load(spark, folder, "documents").select(uri, now.alias("arrived"), F.encode("text", "UTF-8").alias("content")).write.parquet(src)
    handler = files.Handler("PlainHandler", "1", ("TEXT",), markup.text_pages)
    runs = spark.createDataFrame([RUN], RUN_COLUMNS)
    for _ in range(2):
        stream = spark.readStream.schema("uri string, arrived timestamp, content binary").parquet(src)
        job = ingest.stream_ingest(
            stream, out, scratch_path(spark, "progress"), [handler], runs, embedding.hashing_provider(64), 64, "hashing", {"txt": "TEXT"}, now
        )
        job.awaitTermination()
    names = current_documents(spark, out).select(F.col("id").alias("document_id"), "file_name")
    page = F.get_json_object("metadata", "$.page_number").cast("int").alias("page_number")
    rows = stored_chunks(spark, out).join(names, "document_id")
    configs = stored_configs(spark, out).agg(F.count(F.lit(1)).alias("configs"))
    return rows.select("document_id", "file_name", "chunk_index", page, "content", "token_count").join(F.broadcast(configs))


@query("stream_counter", "SELECT user_id, 5 + count(*) AS counter FROM events GROUP BY user_id")
def stream_counter(spark, folder):
    out = scratch_path(spark, "counters")
    stream = spark.readStream.schema(load(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counter.stream_counter(stream, "user_id", out, scratch_path(spark, "progress"), start=5).awaitTermination()
    return counter.latest_counters(spark, out, "user_id")
