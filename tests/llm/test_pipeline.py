"""The registered training-data queries and the pipeline over the smallest tables."""
import sys

import pytest
from pyspark.sql import functions as F

from oracle import compare

from passagework.llm.queries import ORACLE, QUERIES

FOLDER, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


#: Queries whose rows are not those of a table.
OTHER = ("op11_packing", "op12_dialogue_repair", "op13_source_divergence")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(OTHER)))
def test_query_returns_a_row_for_each_row(spark, name):
    table = {"op1": "pages", "op9": "pages", "op2": "embeddings"}.get(name.split("_")[0], "documents")
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, name, FOLDER, QUERIES, ORACLE) == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, MORE).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[5] == counts[4]
    whole = corpus_pipeline.run(spark, MORE)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.select(whole.columns).collect()))


def test_sharded_corpus_has_its_texts_and_clashing_columns(spark):
    import corpus_pipeline

    rows = [(1, "a b"), (1, "c"), (None, None), (2, ""), (2, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit("own")).withColumn("Shard", F.lit(7))
    found = corpus_pipeline.shard(spark, docs, FOLDER)
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert {tuple(r.given) for r in found.collect()} == {("own", 7)} and found.schema["shard"].dataType.simpleString() == "int"
    plain = corpus_pipeline.shard(spark, docs.select("doc_id", "text"), FOLDER)
    assert plain.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Nulls, repeated ids with other texts, copies, empty and long texts; then an empty table."""
    import corpus_pipeline

    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    kind = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    clean = [" ".join(f"w{n}x{i}" for i in range(40)) for n in range(6)]
    rows = [(1, clean[0]), (1, clean[1]), (2, clean[1]), (None, clean[2]), (3, None), (4, ""), (5, clean[3] + " y" * 500_000), (6, clean[4]), (6, clean[4])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k else None, 0) for k, (i, t) in enumerate(rows)], kind)
    kept = corpus_pipeline.drop_contaminated(spark, corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted(
        [(1, len(clean[0])), (1, len(clean[1])), (0, len(clean[2])), (3, 0), (5, len(rows[6][1])), (6, len(clean[4]))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.text for r in whole} <= {t for _, t in rows} and len(whole) > 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_near_copies_are_brought_together_by_fingerprints(spark, monkeypatch):
    """The SimHash step runs in its stage, and its keys alone bring near copies to the exact check; unlike texts stay."""
    import corpus_pipeline
    from passagework.llm import copies, simhash

    base = [" ".join(f"v{n}w{i}" for i in range(400)) for n in range(3)]
    texts = [base[0], base[0] + " tail", base[1], base[2], base[2], None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    coded = simhash.with_fingerprint(docs, width=copies.WIDTH).withColumn("node", copies.text_node("text"))
    keyed = copies.fingerprint_keys(coded.select("node", "fingerprint")).distinct()
    codes = [simhash.fingerprint(t.encode(), copies.WIDTH) for t in texts[:2]]
    assert ((codes[0] ^ codes[1]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS
    nodes = {r.doc_id: r.node for r in coded.collect()}
    assert [(r.a, r.b) for r in copies.similar_links(docs, keyed).collect()] == [tuple(sorted((nodes[0], nodes[1])))]
    calls = []
    monkeypatch.setattr(copies, "near_fingerprints", lambda *a: calls.append(a) or simhash.near_fingerprints(*a))
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5] and calls


def test_entry_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op7_simhash" in entry.queries()
    for name in [n for n in sys.modules if n.startswith("passagework.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and "context_block" in entry.queries()
