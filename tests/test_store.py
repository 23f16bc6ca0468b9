"""The store of the ingest job: unchanged files, pruned reads, compaction, overwriting, sequence numbers."""
import pytest
from pyspark.sql import functions as F

from passagework.operators import embedding, ingest, vector_cache
from passagework.registry.store import RUN, RUN_COLUMNS
from passagework.sources import files, markup, tables


@pytest.fixture()
def taken(spark, tmp_path):
    """A function that takes in texts by name, and the store's path; it counts the files that were parsed."""
    path, parsed = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def pages(rows):
        def seen(batches):
            for batch in batches:
                parsed.add(len(batch))
                yield batch

        return markup.text_pages(rows.mapInPandas(seen, rows.schema))

    handler = files.Handler("PlainHandler", "1", ("TEXT",), pages)
    clock = iter(range(1_700_000_000, 1_800_000_000))

    def take(batch, texts, runs=(RUN,), **options):
        found = spark.createDataFrame([(f"dir/{n}.txt", bytearray(t.encode())) for n, t in texts.items()], "uri string, content binary")
        now = F.timestamp_seconds(F.lit(next(clock)))
        report, _ = ingest.ingest_found(
            found, path, batch, [handler], spark.createDataFrame(list(runs), RUN_COLUMNS), embedding.hashing_provider(64), 64, "m", {"txt": "TEXT"}, now, **options
        )
        return {r.file_name: (r.embedded, r.inserted) for r in report.collect()}

    return take, path, parsed


def documents(spark, path):
    return {r.file_name: r for r in ingest.current_documents(spark, path).collect()}


def test_unchanged_files_are_not_parsed_or_stored_again(spark, taken):
    take, path, parsed = taken
    two = {"a": "One two. " * 60, "b": "Three."}
    first = take("1", two)
    assert parsed.value == 2 and first["a.txt"][0] == first["a.txt"][1] > 1
    created = documents(spark, path)["a.txt"].created_at
    again = [take(b, two) for b in ("2", "3")]
    assert again[0] == {n: (e, 0) for n, (e, _) in first.items()} == again[1] and parsed.value == 2
    assert tables.read_committed(spark, path, "documents", tables.TABLES["documents"]).count() == 2
    row = documents(spark, path)["a.txt"]
    assert row.created_at == created and row.updated_at > created
    take("4", {"a": "Changed.", "b": "Three."})
    assert parsed.value == 3 and tables.read_committed(spark, path, "documents", tables.TABLES["documents"]).count() == 3
    # back to the first content: the document's facts follow, though that content was once stored
    take("5", two)
    assert parsed.value == 4 and documents(spark, path)["a.txt"].content_hash == documents(spark, path)["a.txt"].content_hash != row.id
    assert documents(spark, path)["a.txt"].byte_size == len(two["a"])


def test_a_second_config_takes_the_same_files_in_again(spark, taken):
    take, path, parsed = taken
    other = (*RUN[:2], '{"chunk_size": 64, "min_characters_per_chunk": 8}', *RUN[3:])
    take("1", {"a": "One two. " * 60})
    assert take("2", {"a": "One two. " * 60}, (RUN, other))["a.txt"][1] > 0 and parsed.value == 2
    chunks = ingest.stored_chunks(spark, path)
    config = chunks.first().extraction_config_hash
    plan = chunks.filter(F.col("extraction_config_hash") == config)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(extraction_config_hash" in text
    read = [r[0] for r in plan.select("_metadata.file_path").distinct().collect()] if "_metadata" in plan.columns else plan.inputFiles()
    assert plan.count() < chunks.count() and len(read) > 0


def test_only_batches_that_can_hold_the_ids_are_read(spark, taken):
    take, path, _ = taken
    for n in range(6):
        take(f"b{n}", {f"f{n}": f"Text number {n}."})
    ids = ingest.current_documents(spark, path).filter("file_name = 'f4.txt'").select("id")
    assert tables.batches_with(spark, path, ids, "id") == ["b4"]
    held = ingest.stored_chunks(spark, path, ["b4"])
    assert held.count() == 1 and "PartitionFilters: [batch" in held._jdf.queryExecution().executedPlan().toString().replace("isnotnull(batch", "batch")
    assert tables.batches_with(spark, path, ids.limit(0), "id") == []


def test_compaction_and_overwriting_keep_what_readers_see(spark, taken):
    take, path, parsed = taken
    take("1", {"a": "Old. ", "b": "Bb."})
    take("2", {"a": "New text.", "c": "Cc."})
    take("3", {"b": "Bb."})

    def seen():
        chunks = sorted((r.document_id, r.chunk_index, r.content) for r in ingest.stored_chunks(spark, path).collect())
        rows = sorted((r.file_name, r.content_hash, r.created_at, r.updated_at) for r in ingest.current_documents(spark, path).collect())
        return chunks, rows, ingest.stored_configs(spark, path).collect()

    before = seen()
    assert ingest.compact(spark, path, "all") and seen() == before
    assert tables.committed(spark, path) == (["all"], 3) and not ingest.compact(spark, path, "all2")
    done = parsed.value
    take("4", {"a": "New text.", "d": "Dd."})
    assert parsed.value == done + 1 and set(documents(spark, path)) == {"a.txt", "b.txt", "c.txt", "d.txt"}
    take("5", {"a": "New text."}, overwrite=True)
    assert set(documents(spark, path)) == {"a.txt"} and ingest.stored_chunks(spark, path).count() == 1
    assert tables.committed(spark, path)[0] == ["5"] and ingest.stored_configs(spark, path).count() == 1
    take("5", {"e": "Ee."})
    assert set(documents(spark, path)) == {"a.txt"}


def test_two_writers_do_not_get_the_same_number(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(3).select("id")
    assert tables.commit_batch(path, {"documents": rows}, "a")
    assert tables._claim(spark, path, 2) == 2  # another writer, which has not committed yet
    assert tables.commit_batch(path, {"documents": rows}, "b")
    assert sorted(r.sequence for r in tables._marks(spark, path).collect()) == [1, 3]


def test_a_text_reaches_the_provider_once(spark, tmp_path):
    path, asked = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def factory():
        real = embedding.hashing_provider(16)()

        def provide(texts):
            asked.add(len(texts))
            return real(texts)

        return provide

    texts = [f"text number {i % 60}" for i in range(100)] + [None, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("digest", F.lit("own")).repartition(5)
    first = vector_cache.embed_cached(rows, factory, "m", path, "1")
    assert first.columns == ["id", "text", "digest", "embedding", "embedding_model"]
    plain = {r.id: r.embedding for r in embedding.embed_chunks(rows, embedding.hashing_provider(16), "m").collect()}
    assert {r.id: r.embedding for r in first.collect()} == plain and asked.value == 62
    more = spark.createDataFrame([(1, "text number 5"), (2, "new text")], "id int, text string")
    assert vector_cache.embed_cached(more, factory, "m", path, "2").count() == 2 and asked.value == 63
    assert vector_cache.embed_cached(more, factory, "other", path, "3").count() == 2 and asked.value == 65
    assert vector_cache.embed_cached(rows.limit(0), factory, "m", path, "4").count() == 0


def test_ingest_asks_for_known_texts_only_once(spark, taken, tmp_path):
    take, path, _ = taken
    cache = str(tmp_path / "cache")
    other = (*RUN[:1], RUN[1], '{"chunk_size": 257, "min_characters_per_chunk": 24}', *RUN[3:])
    take("1", {"a": "Same text.", "b": "Same text."}, vectors=cache)
    take("2", {"a": "Same text.", "b": "Same text."}, (RUN, other), vectors=cache)
    assert ingest.stored_chunks(spark, path).count() == 4
    assert tables.read_committed(spark, cache, "vectors", vector_cache.VECTORS).count() == 1


def test_a_large_folder_is_written_by_several_tasks(spark, tmp_path):
    """Rows of one folder are cut by size, so no task sorts a whole bucket; a batch whose check fails does not count."""
    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(1).alias("bucket")).repartition(6)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        assert tables.commit_batch(str(tmp_path), {"t": rows}, "b", {"t": ["bucket"]})
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "t" / "batch=b" / "bucket=1").glob("*.parquet"))) > 1
    assert tables.read_committed(spark, str(tmp_path), "t", "text string, bucket int").count() == 60_000

    def refuse():
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        tables.commit_batch(str(tmp_path), {"t": rows}, "c", {"t": ["bucket"]}, check=refuse)
    assert tables.committed(spark, str(tmp_path))[0] == ["b"]


def test_repeated_page_numbers_give_every_chunk_once(spark, tmp_path):
    """A handler that numbers two pages alike: of the equal keys the smaller content is stored, as it is without repeats; a wrong width commits nothing."""
    def twice(rows):
        pages = markup.text_pages(rows)
        return pages.unionByName(pages.withColumn("content", F.concat(F.lit("z"), "content")))

    found = spark.createDataFrame([("a.txt", bytearray(b"first text")), ("b.txt", bytearray(b"other text"))], "uri string, content binary")
    runs, now = spark.createDataFrame([RUN], RUN_COLUMNS), F.lit("2024-01-01").cast("timestamp")
    for name, parse in (("plain", markup.text_pages), ("twice", twice)):
        handler, path = files.Handler("H", "1", ("TEXT",), parse), str(tmp_path / name)
        with pytest.raises(ValueError, match="embedding refused"):
            ingest.ingest_found(found, path, "w", [handler], runs, embedding.hashing_provider(4), 8, "m", {"txt": "TEXT"}, now)
        assert tables.committed(spark, path) == ([], 0)
        report, _ = ingest.ingest_found(found, path, "x", [handler], runs, embedding.hashing_provider(8), 8, "m", {"txt": "TEXT"}, now)
        assert sorted(r["content"] for r in ingest.stored_chunks(spark, path).collect()) == ["first text", "other text"]
        assert sorted(r["inserted"] for r in report.collect()) == [1, 1]


def test_large_files_are_compacted_as_they_lie_and_replaced_folders_go(spark, taken, monkeypatch):
    import os

    take, path, _ = taken
    for n in range(3):
        take(f"b{n}", {f"f{n}": f"Text number {n}. " * 40, "same": "Same."})
    rows = sorted(map(str, ingest.stored_chunks(spark, path).drop("created_at").collect()))
    ways, written = [], tables.commit_batch

    def commit(*given, **options):
        ways.append(options["dealt"])
        return written(*given, **options)

    monkeypatch.setattr(ingest, "commit_batch", commit)
    monkeypatch.setattr(ingest, "COMPACT_BYTES", 1)
    assert ingest.compact(spark, path, "one") and ways == [("chunks",)]
    assert len(os.listdir(f"{path}/chunks")) == 4
    ingest.remove_replaced(spark, path)
    for table in (*tables.TABLES, "takes"):
        assert [f for f in os.listdir(f"{path}/{table}") if f.startswith("batch=")] == ["batch=one"]
    assert sorted(map(str, ingest.stored_chunks(spark, path).drop("created_at").collect())) == rows
    assert documents(spark, path).keys() == {"f0.txt", "f1.txt", "f2.txt", "same.txt"}
    monkeypatch.setattr(ingest, "COMPACT_BYTES", 1 << 40)
    take("b4", {"f4": "New."})
    assert ingest.compact(spark, path, "two") and ways[-1] == ()
    assert len(ingest.stored_chunks(spark, path).collect()) == len(rows) + 1


def test_a_run_leaves_no_texts_in_the_scratch_folder(spark, taken):
    import os

    from passagework.session import scratch_root

    take, path, _ = taken
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    assert take("1", {"a": "One two. " * 60})["a.txt"][1] > 1
    left = {f.rpartition("-")[0] for f in set(os.listdir(root)) - before}
    assert "facts" in left and not left & {"pages", "chunks"}
