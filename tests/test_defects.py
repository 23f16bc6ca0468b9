"""Cases in which an earlier version gave wrong results."""
import pytest
from pyspark.sql import functions as F

from passagework.functions.metadata import merge_metadata
from passagework.operators import chunking, provenance, retrieval
from passagework.session import scratch_root
from passagework.sources import evalset


def test_chunks_are_numbered_per_config(spark):
    rows = [("d", 1, p, c) for c, n in (("a", 3), ("b", 2)) for p in range(n)] + [("d", 2, p, c) for c in "ab" for p in range(2)]
    chunks = spark.createDataFrame(rows, "document_id string, page_number int, piece_no int, config_hash string")
    got = chunking.number_chunks(chunks).collect()
    for config, total in (("a", 5), ("b", 4)):
        assert sorted(r.chunk_index for r in got if r.config_hash == config) == list(range(total))


def test_broken_evaluation_file_is_refused(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"user_input": "q", "reference": "r"}]')
    (tmp_path / "broken.json").write_text('[{"user_input": "q", ')
    good, bad = evalset.read_samples(spark, str(tmp_path))
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["not a JSON list of objects"]
    with pytest.raises(evalset.BadSamples, match="JSON list"):
        evalset.load_eval_set(spark, str(tmp_path))


def test_null_metadata_counts_as_empty(spark):
    frame = spark.sql("SELECT cast(null AS map<string,string>) AS a, map('k', 'v') AS b")
    row = frame.select(merge_metadata(F.col("a"), F.col("b")).alias("x"), merge_metadata(F.col("b"), F.col("a")).alias("y")).first()
    assert row.x == {"k": "v"} and row.y == {"k": "v"}


def test_missing_page_number_is_written_as_null(spark):
    frame = spark.sql("SELECT cast(null AS map<string,string>) AS page_meta, cast(null AS int) AS page_number, 0 AS start_index, 3 AS end_index, 'm' AS embedding_model")
    assert provenance.chunk_metadata(frame).first().metadata == '{"embedding_model":"m","end_index":3,"page_number":null,"start_index":0}'


def test_chunks_without_document_take_no_rank(spark):
    chunks = spark.createDataFrame([("gone", 0, [1.0, 0.0]), ("here", 0, [0.9, 0.1])], "document_id string, chunk_index int, embedding array<float>")
    chunks = chunks.withColumn("extraction_config_hash", F.lit("c")).withColumn("config_hash", F.lit("c"))
    documents = spark.createDataFrame([("here", "f")], "id string, file_name string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 0)], "query_id int, embedding array<float>, top_k int")
    got = retrieval.search(asked, chunks, documents).collect()
    assert [(r.query_id, r.document_id) for r in got] == [(1, "here")]


def test_local_scratch_needs_a_local_master(spark):
    assert scratch_root(spark)

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Cluster)


def test_report_keeps_documents_of_one_name_apart(spark):
    rows = [("d1", 0, "x"), ("d1", 1, "y"), ("d2", 0, "z")]
    batch = spark.createDataFrame(rows, "document_id string, chunk_index int, content string").withColumn("extraction_config_hash", F.lit("c"))
    documents = spark.createDataFrame([("d1", "a.txt"), ("d2", "a.txt")], "id string, file_name string")
    got = provenance.ingest_report(documents, batch.where("document_id = 'd2'"), batch).collect()
    assert sorted((r.file_name or "", r.embedded, r.inserted) for r in got) == [("", 3, 2), ("a.txt", 1, 0), ("a.txt", 2, 2)]
