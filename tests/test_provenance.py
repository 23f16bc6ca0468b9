import hashlib
import json

import pytest
from pyspark.sql import functions as F

from passagework.operators import provenance as P
from passagework.session import scratch_path
from passagework.sources import tables

CONFIG = {
    "embedding_provider": "sağlayıcı", "embedding_model": "m", "embedding_size": 1024, "chonkie_ver": "1.2",
    "chunking_method": "recursive", "chunking_method_params": {"min_characters_per_chunk": 24, "chunk_size": 8123, "mode": "x y"},
    "tokenizer": "character", "parser": "P", "parser_ver": "1", "parser_params": {},
}


def configs(spark, *dicts):
    rows = [{k: json.dumps(v, ensure_ascii=False) if k in P.PARAMS else v for k, v in d.items()} for d in dicts]
    schema = ", ".join(f"{f} {'int' if f == 'embedding_size' else 'string'}" for f in P.CONFIG_FIELDS)
    return spark.createDataFrame([tuple(r[f] for f in P.CONFIG_FIELDS) for r in rows], schema)


def test_fingerprint_is_the_hash_of_sorted_compact_json(spark):
    text_size = {**CONFIG, "chunking_method_params": {"chunk_size": "8123"}}
    reordered = dict(reversed(CONFIG.items()))
    got = [r.config_hash for r in P.fingerprint(configs(spark, CONFIG, text_size, reordered)).collect()]
    want = [
        hashlib.sha256(json.dumps(c, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        for c in (CONFIG, text_size, reordered)
    ]
    assert got == want and got[0] == got[2] != got[1]


KEYED = "document_id string, chunk_index int, extraction_config_hash string, content string"


def test_second_ingest_inserts_nothing_and_leaves_stale_text(spark):
    first = spark.createDataFrame([("d", 0, "c", "old"), ("d", 1, "c", "same"), ("d", 2, "c", "tail")], KEYED)
    again = spark.createDataFrame([("d", 0, "c", "new"), ("d", 1, "c", "same")], KEYED)
    stored = P.insert_chunks(first.limit(0), first)
    assert P.new_chunks(stored, first).count() == 0
    after = P.insert_chunks(stored, again)
    assert {r.content for r in after.collect()} == {"old", "same", "tail"}
    assert {(r.chunk_index, r.state) for r in P.stale_chunks(after, again).collect()} == {(0, "changed"), (2, "removed")}


def test_digests_leave_out_equal_documents_only(spark):
    stored = [("same", 0, "c", "a"), ("same", 1, "c", None), ("swap", 0, "c", "a"), ("swap", 1, "c", "b"), ("more", 0, "c", "a"), ("less", 0, "c", "a"), ("less", 1, "c", "b"),
              ("gone", 0, "c", "a"), ("null", 0, "c", None), ("other", 0, "c", "a"), ("other", 0, "d", "a")]
    now = [("same", 1, "c", None), ("same", 0, "c", "a"), ("swap", 0, "c", "b"), ("swap", 1, "c", "a"), ("more", 0, "c", "a"), ("more", 1, "c", "b"), ("less", 0, "c", "a"),
           ("null", 0, "c", ""), ("other", 0, "c", "a"), ("other", 0, "d", "x"), (None, 0, "c", "a")]
    before, after = spark.createDataFrame(stored, KEYED), spark.createDataFrame(now, KEYED)
    digests = P.chunk_digests(before)
    differing = {tuple(r) for r in P.differing_documents(digests, after).collect()}
    assert differing == {("swap", "c"), ("more", "c"), ("less", "c"), ("null", "c"), ("other", "d"), (None, "c")}
    plain, pruned = (sorted(map(tuple, P.stale_chunks(before, after, d).collect())) for d in (None, digests))
    assert plain == pruned and len(plain) == 5
    parts = [P.chunk_digests(before.where(f"chunk_index = {i}")).where("document_id = 'swap'").first().digest for i in (0, 1)]
    whole = digests.where("document_id = 'swap'").first().digest
    assert [a + b for a, b in zip(*parts)] == list(whole)
    assert P.stale_chunks(before, after.limit(0), digests).count() == 0 and P.stale_chunks(before, after, digests.limit(0)).count() == 5


def test_first_of_repeated_keys_wins_also_when_hot(spark):
    batch = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("document_id"),
        F.lit(0).alias("chunk_index"), F.lit("c").alias("extraction_config_hash"),
        (F.lit(10**6) - F.col("id")).cast("string").alias("content"), F.col("id"),
    )
    got = P.new_chunks(batch.limit(0), batch, [F.col("id")])
    assert got.count() == 20_001
    assert got.filter("document_id = 'hot'").first().id == 0


def test_upsert_keeps_id_and_created_at(spark):
    t = "timestamp'2024-01-01'"
    row = "'f' file_name, 'm' mime_type, 1L byte_size, 'h' content_hash, '{}' metadata"
    old = spark.sql(f"SELECT 'ID' id, 'u' uri, {row}, {t} created_at, {t} updated_at")
    new = spark.sql(f"SELECT 'u' uri, 1 o, {row} UNION ALL SELECT 'u', 2, 'f2', NULL, 2L, 'h2', '{{}}' UNION ALL SELECT 'v', 1, 'g', 'm', 3L, 'h3', '{{}}'")
    now = F.lit("2024-06-01").cast("timestamp")
    got = {r.uri: r for r in P.upsert_documents(old, new, now, [F.col("o")]).collect()}
    assert got["u"].id == "ID" and got["u"].file_name == "f2" and got["u"].mime_type is None
    assert got["u"].created_at.month == 1 and got["u"].updated_at.month == 6
    assert got["v"].id == hashlib.sha256(b"v").hexdigest() and got["v"].created_at.month == 6


def test_chunk_metadata_escapes_and_computed_keys_win(spark):
    rows = spark.sql("SELECT map('end_index', 'x', 'q\"', 'é\\n') page_meta, 2 page_number, 3 start_index, 9 end_index, 'm' embedding_model")
    got = json.loads(P.chunk_metadata(rows).first().metadata)
    assert got == {"end_index": 9, 'q"': "é\n", "page_number": 2, "start_index": 3, "embedding_model": "m"}


def test_batches_show_only_once_committed(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(5).select("id")
    assert tables.read_committed(spark, path, "documents", "id bigint").count() == 0
    assert tables.commit_batch(path, {"documents": rows}, "a")
    rows.write.parquet(f"{path}/documents/batch=b")  # an attempt that died before its marker
    assert tables.read_committed(spark, path, "documents", "id bigint").count() == 5
    assert tables.commit_batch(path, {"documents": rows.limit(2)}, "b")
    assert not tables.commit_batch(path, {"documents": rows}, "b")
    assert {(r.batch, r.sequence) for r in tables.read_committed(spark, path, "documents", "id bigint").collect()} == {("a", 1), ("b", 2)}
    assert tables.read_committed(spark, path, "documents", "id bigint").count() == 7


def test_table_lifecycle(spark, tmp_path):
    prefix, folder = "lifecycle_", str(tmp_path)
    assert not tables.tables_exist(spark, prefix)
    assert tables.reset_tables(spark, prefix, folder) is False and tables.tables_exist(spark, prefix)
    spark.sql(f"INSERT INTO {prefix}extraction_configs VALUES ('h', '{{}}', now())")
    assert tables.reset_tables(spark, prefix, folder) is False
    assert spark.table(f"{prefix}extraction_configs").count() == 1
    assert tables.reset_tables(spark, prefix, scratch_path(spark, "other"), overwrite=True) is True
    assert spark.table(f"{prefix}extraction_configs").count() == 0


def test_config_filter_prunes_folders(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, h, "t") for h in "abc"], KEYED)
    tables.write_tables(chunks.limit(0), chunks.limit(0), chunks, str(tmp_path))
    plan = tables.read_table(spark, str(tmp_path), "chunks").filter("extraction_config_hash = 'b'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(extraction_config_hash" in text and plan.select("_metadata.file_path").distinct().count() == 1


@pytest.mark.parametrize("uri,state", [("same", "unchanged"), ("diff", "changed"), ("gone", "gone"), ("new", "new"), ("nul", "unchanged")])
def test_source_states(spark, uri, state):
    old = spark.createDataFrame([("same", "1"), ("diff", "1"), ("gone", "1"), ("nul", None)], "uri string, content_hash string")
    now = spark.createDataFrame([("same", "1"), ("diff", "2"), ("new", "1"), ("nul", None)], "uri string, content_hash string")
    assert {r.uri: r.state for r in P.diff_sources(old, now).collect()}[uri] == state
