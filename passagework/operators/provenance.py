"""Extraction configs, idempotent writes of documents and chunks, audits of the stored tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.metadata import merge_metadata
from passagework.plans.checks import first_per_key, last_per_key

# The config fields in alphabetical order; those in PARAMS are JSON objects whose numbers stay numbers.
CONFIG_FIELDS = (
    "chonkie_ver",
    "chunking_method",
    "chunking_method_params",
    "embedding_model",
    "embedding_provider",
    "embedding_size",
    "parser",
    "parser_params",
    "parser_ver",
    "tokenizer",
)
PARAMS = ("chunking_method_params", "parser_params")
CHUNK_KEY = ["document_id", "chunk_index", "extraction_config_hash"]
# Document columns refreshed when a known source is written again.
REFRESHED = ("file_name", "mime_type", "byte_size", "content_hash", "metadata")


def document_id(uri: Column) -> Column:
    """Id that a retried task computes again: the hash of the source location."""
    return F.sha2(uri, 256)


def chunk_id(document: Column, index: Column, config_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", document, index.cast("string"), config_hash), 256)


def canonical_config() -> Column:
    """Canonical JSON of the config columns: keys sorted at every level, no blanks, non-ASCII kept."""
    fields = [F.parse_json(F.col(c)).alias(c) if c in PARAMS else F.col(c) for c in CONFIG_FIELDS]
    return F.to_json(F.struct(*fields))


def fingerprint(configs: DataFrame) -> DataFrame:
    """Adds ``config`` (canonical JSON) and ``config_hash`` (its sha256)."""
    return configs.withColumn("config", canonical_config()).withColumn("config_hash", F.sha2("config", 256))


def derive_configs(routed: DataFrame, run_params: DataFrame) -> DataFrame:
    """One config per handler met in ``routed`` (parser, parser_ver) under each row of run parameters.

    Distinct handlers come first, so the pairing with the run parameters works on a handful of rows.
    """
    handlers = routed.select("parser", "parser_ver").distinct().withColumn("__run", F.lit(0))
    runs = run_params.withColumn("__run", F.lit(0))
    return fingerprint(handlers.join(runs, "__run").drop("__run").withColumn("parser_params", F.lit("{}")))


def insert_configs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing configs plus those whose hash was absent."""
    once = first_per_key(new.select(*existing.columns), ["config_hash"], [F.col("created_at")])
    return existing.unionByName(once.join(existing, "config_hash", "left_anti"))


def upsert_documents(existing: DataFrame, new: DataFrame, now: Column, order: list[Column]) -> DataFrame:
    """Documents after writing ``new`` by ``uri``.

    A known uri keeps id and created_at and takes the new values; an unknown one is inserted. When ``new`` names a uri
    several times the last along ``order`` counts. Columns: id, uri, the refreshed ones, created_at, updated_at.
    """
    incoming = last_per_key(
        new.select("uri", *REFRESHED, *[c.alias(f"__o{i}") for i, c in enumerate(order)]),
        ["uri"],
        [F.col(f"__o{i}") for i in range(len(order))],
    ).select("uri", *REFRESHED)
    old, fresh = existing.alias("old"), incoming.alias("new")
    given = F.col("new.uri").isNotNull()
    uri = F.coalesce("old.uri", "new.uri")
    return old.join(fresh, F.col("old.uri") == F.col("new.uri"), "full_outer").select(
        F.coalesce("old.id", document_id(uri)).alias("id"),
        uri.alias("uri"),
        *[F.when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in REFRESHED],
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(given, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def new_chunks(existing: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``batch`` that an insert-only write adds: unknown keys, and of repeated keys the first along ``order``.

    ``existing`` needs only the key columns. Without ``order`` the smallest content counts as first.
    """
    once = first_per_key(batch, CHUNK_KEY, order or [F.col("content")])
    return once.join(existing.select(*CHUNK_KEY), CHUNK_KEY, "left_anti")


def insert_chunks(existing: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    return existing.unionByName(new_chunks(existing, batch, order).select(*existing.columns))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds ``metadata``: the page metadata with page_number, start_index, end_index and embedding_model on top.

    The result is JSON text in key order: page entries as text, the computed positions as numbers.
    """
    numbers = ("end_index", "page_number", "start_index")
    computed = F.create_map(
        *[x for n in numbers for x in (F.lit(n), F.col(n).cast("string"))],
        F.lit("embedding_model"), F.col("embedding_model"),
    )
    entries = F.array_sort(F.map_entries(merge_metadata(F.col("page_meta"), computed)))

    def text_of(e: Column) -> Column:
        # One-entry JSON objects without their braces keep the escaping rules of the built-in writer.
        quoted = F.to_json(F.map_from_entries(F.array(e)))
        bare = F.concat(F.lit('{"'), e["key"], F.lit('":'), F.coalesce(e["value"], F.lit("null")), F.lit("}"))
        return F.regexp_replace(F.when(e["key"].isin(*numbers), bare).otherwise(quoted), r"^\{|\}$", "")

    return chunks.withColumn("metadata", F.concat(F.lit("{"), F.array_join(F.transform(entries, text_of), ","), F.lit("}")))


def ingest_report(documents: DataFrame, existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(file_name, embedded, inserted) per document plus a total row with a null file name."""
    offered = batch.groupBy("document_id").agg(F.count(F.lit(1)).alias("embedded"))
    written = new_chunks(existing, batch).groupBy("document_id").agg(F.count(F.lit(1)).alias("inserted"))
    per_file = (
        offered.join(written, "document_id", "left")
        .join(documents.select(F.col("id").alias("document_id"), "file_name"), "document_id")
        .withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    )
    sums = per_file.rollup("document_id", "file_name").agg(
        F.sum("embedded").alias("embedded"), F.sum("inserted").alias("inserted"), F.grouping_id().alias("level")
    )
    return sums.where(F.col("level").isin(0, 3)).select("file_name", "embedded", "inserted")


def fk_violations(chunks: DataFrame, documents: DataFrame, configs: DataFrame) -> DataFrame:
    """Chunk keys whose document or config does not exist, with the broken reference."""
    docs = documents.select(F.col("id").alias("document_id"))
    known = configs.select(F.col("config_hash").alias("extraction_config_hash"))
    keys = chunks.select(*CHUNK_KEY)
    return (
        keys.join(docs, "document_id", "left_anti").withColumn("violation", F.lit("document"))
        .unionByName(keys.join(known, "extraction_config_hash", "left_anti").withColumn("violation", F.lit("config")))
    )


def key_violations(rows: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(violation, detail, rows): repeated keys and null counts of required columns, only where something is wrong."""
    repeated = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        .select(F.lit("duplicate key").alias("violation"),
                F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("detail"), "rows")
    )
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    missing = (
        nulls.unpivot([], required, "detail", "rows").filter("rows > 0")
        .select(F.lit("null value").alias("violation"), "detail", "rows")
    )
    return repeated.unionByName(missing)


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) without the ids in ``gone`` (column id); chunks follow their document."""
    left = documents.join(gone.select("id"), "id", "left_anti")
    kept = chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return left, kept


def chunks_of(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the wanted documents (column id); order by document_id, chunk_index where they are shown."""
    return chunks.join(wanted.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def diff_sources(existing: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, state) with state new, changed, unchanged or gone, by uri and content hash."""
    old, now = existing.alias("old"), files.alias("now")
    state = (
        F.when(F.col("old.uri").isNull(), "new")
        .when(F.col("now.uri").isNull(), "gone")
        .when(F.col("old.content_hash").eqNullSafe(F.col("now.content_hash")), "unchanged")
        .otherwise("changed")
    )
    both = old.join(now, F.col("old.uri") == F.col("now.uri"), "full_outer")
    return both.select(F.coalesce("old.uri", "now.uri").alias("uri"), state.alias("state"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(document_id, extraction_config_hash, chunks, digest) per document and config.

    The digest is two sums of 64-bit hashes of index and content, so it does not depend on the order of rows, is summed before the
    exchange, and digests of disjoint parts of a document can be added. Two equal digests of different chunks are as likely as
    two equal 128-bit hashes.
    """
    def summed(seed: int):
        hashed = F.xxhash64(F.lit(seed), "chunk_index", F.col("content").isNull(), "content")
        return F.sum(hashed.cast("decimal(20,0)"))

    return chunks.groupBy("document_id", "extraction_config_hash").agg(
        F.count(F.lit(1)).alias("chunks"), F.struct(summed(1).alias("first"), summed(2).alias("second")).alias("digest")
    )


def differing_documents(digests: DataFrame, current: DataFrame) -> DataFrame:
    """(document_id, extraction_config_hash) of ``current`` chunks whose digest is not among the stored ``digests``."""
    columns = ["document_id", "extraction_config_hash", "chunks", "digest"]
    return chunk_digests(current).join(digests.select(*columns), columns, "left_anti").select(*columns[:2])


def stale_chunks(existing: DataFrame, current: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Stored chunk keys whose source now gives another text (``changed``) or no such chunk any more (``removed``).

    Only documents present in ``current`` are judged. Texts are compared by hash, so no text is shuffled. With the stored chunks'
    ``digests`` (of ``chunk_digests``, kept when they were written) only chunks of documents whose digests differ are hashed and compared.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*CHUNK_KEY, F.sha2("content", 256).alias(name))

    by = ["document_id", "extraction_config_hash"]
    if digests is None:
        runs = current.select(*by).distinct()
    else:
        runs = differing_documents(digests, current)
        current = current.join(runs, by, "left_semi")
    stored = hashed(existing.join(runs, by, "left_semi"), "stored")
    both = stored.join(hashed(current, "fresh"), CHUNK_KEY, "left")
    state = F.when(F.col("fresh").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("stored").eqNullSafe(F.col("fresh"))).select(*CHUNK_KEY, state.alias("state"))


def config_inventory(chunks: DataFrame) -> DataFrame:
    """(extraction_config_hash, documents, chunks, tokens) per config version.

    Chunks are counted per document first, so that one config holding most rows is spread over many tasks.
    """
    per_document = chunks.groupBy("extraction_config_hash", "document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens")
    )
    return per_document.groupBy("extraction_config_hash").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")
    )
