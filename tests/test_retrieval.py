import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.operators import embedding, retrieval
from passagework.plans import nearest as nearest_plan

rng = np.random.default_rng(7)


def frame(spark, name, matrix, extra=""):
    key = "query_id" if name == "q" else "document_id"
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, f"{key} int, chunk_index int, embedding array<float>")
    return df.drop("chunk_index") if name == "q" else df


def brute(q, c, k, metric):
    q, c = q.astype(np.float32).astype(float), c.astype(np.float32).astype(float)
    out = {}
    for i, x in enumerate(q):
        if metric == "l2":
            rank = -np.sqrt(((c - x) ** 2).sum(1))
        else:
            rank = c @ x
            if metric == "cosine":
                norm = np.linalg.norm(c, axis=1) * np.linalg.norm(x)
                rank = np.where(norm > 0, rank / np.where(norm > 0, norm, 1), -np.inf)
        order = sorted(range(len(c)), key=lambda j: (-round(rank[j], 9), j))[: k if np.isscalar(k) else k[i]]
        out[i] = order
    return out


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.document_id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
@pytest.mark.parametrize("bound", [100_000, 200])
def test_equals_brute_force_with_copies_and_zero_vectors(spark, metric, bound):
    c = rng.normal(size=(900, 8))
    c[::3] = c[0]  # one vector holds a third of all rows
    c[5] = 0
    q = np.vstack([c[0], c[1], -c[0], rng.normal(size=(4, 8)), np.zeros((1, 8))])
    chunks = frame(spark, "c", c).repartition(5)
    got = ids(retrieval.search(frame(spark, "q", q), chunks, k=7, metric=metric, block_bytes=bound))
    assert got == brute(q, c, 7, metric)


def test_small_cells_equal_brute_force(spark):
    from passagework.plans.nearest import bucketed_nearest

    c, q = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    whole = F.lit(0).alias("b")
    found = bucketed_nearest(
        frame(spark, "q", q).select("*", F.lit(5).alias("top_k"), whole), frame(spark, "c", c).select("*", whole),
        ["b"], retrieval.CHUNK_KEYS, query_cell=7, chunk_cell=60,
    )
    assert ids(found) == brute(q, c, 5, "cosine")


def test_own_number_of_results(spark):
    c, q = rng.normal(size=(50, 4)), rng.normal(size=(3, 4))
    queries = frame(spark, "q", q).withColumn("top_k", F.when(F.col("query_id") > 0, F.col("query_id")))
    assert ids(retrieval.search(queries, frame(spark, "c", c), k=15)) == brute(q, c, [15, 1, 2], "cosine")


def test_zero_vector_scores_null_and_comes_last(spark):
    rows = retrieval.search(frame(spark, "q", np.ones((1, 2))), frame(spark, "c", np.array([[0, 0], [-1, -1], [1, 1]])), k=3)
    got = [(r.document_id, r.score) for r in rows.orderBy("rank").collect()]
    assert [d for d, _ in got] == [2, 1, 0] and got[2][1] is None and got[1][1] == pytest.approx(-1)


def test_no_queries(spark):
    empty = frame(spark, "q", np.ones((1, 2))).limit(0)
    assert retrieval.search(empty, frame(spark, "c", np.ones((2, 2)))).count() == 0


def test_best_match_needs_a_positive_score(spark):
    corpus = frame(spark, "c", np.array([[1.0, 0], [1, 0], [0, 1]])).select(F.col("document_id").alias("idx"), "embedding")
    got = retrieval.best_match(frame(spark, "q", np.array([[1.0, 0], [-1, -1]])), corpus, "idx")
    assert {r.query_id: r.idx for r in got.collect()} == {0: 0, 1: None}


def test_approximate_results_are_exact_within_candidates(spark):
    c, q = rng.normal(size=(400, 8)), rng.normal(size=(20, 8))
    c[::3] = c[0]
    qs, cs = frame(spark, "q", q), frame(spark, "c", c)
    exact = retrieval.search(qs, cs, k=5)
    assert ids(retrieval.approx_search(qs, cs, 5, lists=1)) == brute(q, c, 5, "cosine")
    assert ids(retrieval.approx_search(qs, cs, 5, lists=40, probes=40)) == brute(q, c, 5, "cosine")
    recall = retrieval.recall_against(exact, retrieval.approx_search(qs, cs, 5)).agg(F.avg("recall")).first()[0]
    assert 0.5 < recall <= 1


def test_approximate_search_without_usable_chunks(spark):
    qs, cs = frame(spark, "q", np.ones((2, 3))), frame(spark, "c", np.zeros((4, 3)))
    assert retrieval.approx_search(qs, cs.limit(0), 2).count() == 0
    assert [r.score for r in retrieval.approx_search(qs, cs, 2).collect()] == [None] * 4


def test_sparse_equals_dense(spark):
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "Kl"], size=rng.integers(0, 9))) for _ in range(120)]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "document_id int, chunk_index int, text string")
    queries = rows.filter("length(text) > 0").select(F.col("document_id").alias("query_id"), "text")
    sparse = retrieval.sparse_search(embedding.hashed_counts(queries, "text", 64), embedding.hashed_counts(rows, "text", 64), 6)
    provider = embedding.hashing_provider(64)
    dense = retrieval.search(embedding.embed_chunks(queries, provider, "m"), embedding.embed_chunks(rows, provider, "m"), k=6)
    assert ids(sparse) == ids(dense)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.l2_distance(F.col("a"), F.col("b")), V.l2_normalize(F.col("a")),
                  V.vector_from_text(V.vector_to_text(F.col("a")))).collect()
    assert r[0][0] == 0 and r[0][1] == pytest.approx(50**0.5) and r[0][2] == [0.6, 0.8] and r[0][3] == [3.0, 4.0]
    assert r[1][0] is None and r[1][2] is None


def test_damaged_vectors_are_split_off(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])]
    good, bad = embedding.check_vectors(spark.createDataFrame(rows, "id int, embedding array<float>"), 2)
    assert [r.id for r in good.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3, 4}


def test_requests(spark):
    rows = [(1, "", None), (2, " ", None), (3, "q", 0), (4, "q", 1), (5, None, 3)]
    good, bad = retrieval.validate_requests(spark.createDataFrame(rows, "id int, question string, top_k int"))
    assert {r.id for r in good.collect()} == {2, 4}
    assert {r.id: r.reason for r in bad.collect()} == {1: "question is empty", 3: "top_k is below 1", 5: "question is empty"}


def test_queries_are_embedded_once_and_windows_bounded(spark):
    asked = spark.sparkContext.accumulator(0)

    def factory():
        def provide(texts):
            asked.add(len(texts))
            return [(i, [1.0, float(len(t))]) for i, t in enumerate(texts)]

        return provide

    texts = spark.createDataFrame([(i, "x" * i) for i in range(9)], "query_id int, text string")
    corpus = frame(spark, "c", rng.normal(size=(60, 2)))
    found = retrieval.search(embedding.embed_chunks(texts, factory, "m"), corpus, k=2, block_bytes=150)
    assert found.count() == 18 and asked.value == 9
    assert found._jdf.queryExecution().sparkPlan().toString().count("WindowGroupLimit") >= 2
    retrieval.best_match(embedding.embed_chunks(texts, factory, "m"), corpus.drop("chunk_index"), "document_id").collect()
    assert asked.value == 18


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_block_bounds_skip_pairs_and_lose_nothing(spark, metric):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    vectors = np.concatenate([c + rng.normal(size=(400, 8)) * 0.2 for c in centres])
    chunks = spark.createDataFrame([("d", i, v.tolist()) for i, v in enumerate(vectors)], "document_id string, chunk_index int, embedding array<double>").repartition(2)
    asked = centres + rng.normal(size=centres.shape) * 0.1
    queries = spark.createDataFrame([(i, 5, v.tolist()) for i, v in enumerate(asked)], "query_id int, top_k int, embedding array<double>")
    space, keys = nearest_plan.DenseVectors(metric), ["document_id", "chunk_index"]
    patch = pytest.MonkeyPatch()
    patch.setattr(nearest_plan, "CHUNK_ROWS", 200)
    patch.setattr(nearest_plan, "QUERY_ROWS", 4)
    got = {(r.query_id, r.rank): r.chunk_index for r in nearest_plan.nearest(queries, chunks, keys, space, 40_000).collect()}
    pairs = nearest_plan.block_pairs(queries, chunks, keys, space, 40_000).first()
    patch.undo()
    products = asked @ vectors.T
    ranks = {"inner": products, "l2": -np.sqrt(((asked[:, None] - vectors[None]) ** 2).sum(2)), "cosine": products / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(vectors, axis=1)}[metric]
    for q in range(len(asked)):
        assert [got[q, r + 1] for r in range(5)] == np.argsort(-np.round(ranks[q], 9), kind="stable")[:5].tolist()
    assert pairs.pairs >= 3 * 24 and pairs.skipped > 0.1 * pairs.pairs


def test_posting_heads_skip_blocks_without_shared_buckets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        topic = i % 10
        buckets = sorted(set((topic * 100 + rng.integers(0, 30, 6)).tolist()))
        rows.append((i, [int(b) for b in buckets], [int(w) for w in rng.integers(1, 5, len(buckets))]))
    chunks = spark.createDataFrame(rows, "chunk_index int, bucket array<int>, weight array<int>").repartition(2)
    queries = spark.createDataFrame([(q, 3, rows[q * 7][1], rows[q * 7][2]) for q in range(20)], "query_id int, top_k int, bucket array<int>, weight array<int>")
    patch = pytest.MonkeyPatch()
    patch.setattr(nearest_plan, "CHUNK_ROWS", 128)
    patch.setattr(nearest_plan, "QUERY_ROWS", 2)
    space = nearest_plan.SparseCounts()
    got = {(r.query_id, r.rank): (r.chunk_index, round(r.score, 9)) for r in nearest_plan.nearest(queries, chunks, ["chunk_index"], space).collect()}
    pairs = nearest_plan.block_pairs(queries, chunks, ["chunk_index"], space).first()
    patch.undo()
    for q in range(20):
        mine = dict(zip(*rows[q * 7][1:]))
        scores = []
        for i, buckets, weights in rows:
            product = sum(w * mine.get(b, 0) for b, w in zip(buckets, weights))
            scores.append((-round(product / np.sqrt(sum(w * w for w in weights) * sum(w * w for w in mine.values())), 9), i))
        assert [got[q, r + 1] for r in range(3)] == [(i, -s) for s, i in sorted(scores)[:3]]
    assert pairs.skipped > 0.5 * pairs.pairs


def test_a_query_is_shuffled_once_a_bucket_not_once_a_list(spark):
    rng = np.random.default_rng(8)
    c, q = rng.normal(size=(900, 8)), rng.normal(size=(30, 8))
    qs, cs = frame(spark, "q", q), frame(spark, "c", c)
    centres, probes = retrieval.pivots(cs, 248), 111
    asked = qs.withColumn("top_k", F.lit(5))
    sent = retrieval._probed_lists(asked, centres, 31, probes, ["query_id"]).collect()
    assert len(sent) <= 30 * 8 < 30 * probes / 10
    got = {i: set() for i in range(30)}
    for r in sent:
        got[r.query_id] |= set(r.bucket * 31 + np.flatnonzero(np.unpackbits(np.frombuffer(r.probed, np.uint8))))
    q32, c32 = q.astype(np.float32).astype(float), c.astype(np.float32).astype(float)
    near = np.argsort(-np.round(q32 @ centres.T, 9), axis=1, kind="stable")[:, :probes]
    assert got == {i: set(near[i].tolist()) for i in range(30)}
    home = np.round(c32 @ centres.T, 9).argmax(1)
    cosine = q32 @ c32.T / np.linalg.norm(q32, axis=1)[:, None] / np.linalg.norm(c32, axis=1)
    open_to = np.array([np.isin(home, near[i]) for i in range(30)])
    wanted = {i: sorted(np.flatnonzero(open_to[i]).tolist(), key=lambda j: (-round(cosine[i, j], 9), j))[:5] for i in range(30)}
    assert ids(retrieval.approx_search(qs, cs, 5, lists=248, probes=probes)) == wanted


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_single_precision_only_preselects_pairs(metric):
    rng = np.random.default_rng(9)
    q, c = rng.normal(size=(40, 16)), rng.normal(size=(700, 16))
    c[::5], c[7] = c[3] + rng.normal(size=16) * 1e-7, 0
    space = nearest_plan.DenseVectors(metric)
    every = np.indices((40, 700)).reshape(2, -1)
    final = np.round(space.pair_ranks(q, c, *every), 9).reshape(40, 700)
    least = np.sort(final, axis=1)[:, -5]
    found = set(zip(*(x.tolist() for x in space.near_pairs(q, c, least))))
    assert found >= set(zip(*(x.tolist() for x in np.nonzero(final >= least[:, None])))) and len(found) < 40 * 700 / 4
    assert space.near_pairs(q * 1e25, c * 1e25, least) is None or metric == "cosine"


def test_counts_keep_long_keys_whole(spark):
    from pyspark.sql import types as T

    schema = T.StructType().add("query_id", "long").add("top_k", "integer").add("k", "string").add(nearest_plan.RANK, "double").add("__pairs", "long").add("__skipped", "long")
    rows = pd.DataFrame({"query_id": [2**60 + 1], "top_k": np.array([3], np.int32), "k": ["x"], nearest_plan.RANK: [0.5]})
    for found in ([rows], []):
        def met(_, found=tuple(found)):
            return nearest_plan._with_counts(found, schema, 7, 2)

        got = [tuple(r) for r in spark.createDataFrame([(1,)], "i int").groupBy("i").applyInPandas(lambda pdf: met(pdf), schema).collect()]
        assert got == [(2**60 + 1, 3, "x", 0.5, None, None)] * len(found) + [(None, None, None, None, 7, 2)]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_sampled_floors_hold_and_spare_pairs(spark, metric, monkeypatch):
    """Every cell starts from the k-th best of the sample: nothing of the result lies below, and far blocks are left out."""
    monkeypatch.setattr(nearest_plan, "CHUNK_ROWS", 64)
    monkeypatch.setattr(nearest_plan, "SAMPLED", 8)
    own = np.random.default_rng(11)
    centres = own.normal(size=(20, 6)) * 10
    c = np.repeat(centres, 64, axis=0) + own.normal(size=(1280, 6)) * 0.01
    q = np.vstack([centres[3] + 0.01, centres[3] - 0.01, np.zeros(6)])
    chunks, queries = frame(spark, "c", c).repartition(1), frame(spark, "q", q).withColumn("top_k", F.when(F.col("query_id") == 1, 2000).otherwise(4))
    space = nearest_plan.DenseVectors(metric)
    cells = 200  # many cells, few blocks in each
    found = ids(nearest_plan.nearest(queries, chunks, ["document_id"], space, cells))
    assert found == brute(q, c, [4, 2000, 4], metric)
    near = queries.filter("query_id = 0")
    pairs = nearest_plan.block_pairs(near, chunks, ["document_id"], space, cells).first()
    assert pairs.skipped >= (15 if metric == "l2" else 3)


def test_hashing_holds_the_words_of_a_slice_of_texts(spark, monkeypatch):
    """Texts are hashed some characters at a time, for the provider and for sparse counts, with the same result."""
    texts = ["one two two", None, "", "three " * 40, "one", "ä ö ü Ä", "two two one one"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    whole = [v.tolist() for _, v in embedding.hashing_provider(16)()(texts)]
    counts = sorted(embedding.hashed_counts(rows, "t", 64).collect())
    held, codes = [], embedding._WordHashes.codes
    monkeypatch.setattr(embedding, "_SLICE_CHARS", 30)
    monkeypatch.setattr(embedding._WordHashes, "codes", lambda self, part: (held.append(part), codes(self, part))[1])
    assert [v.tolist() for _, v in embedding.hashing_provider(16)()(texts)] == whole
    assert sum(held, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 30 for p in held)
    sizes = [len(p) for p in embedding._slices(texts) for p in [texts[p]]]
    assert sum(sizes) == len(texts) and not list(embedding._slices([]))
    for r in counts:
        words = embedding.hashing_provider(64)()([r["t"]])[0][1]
        assert dict(zip(r["bucket"], r["weight"])) == {b: int(w) for b, w in enumerate(words) if w}


def test_search_copies_no_side_for_every_part_of_the_other(spark, monkeypatch):
    """Shuffled bytes follow the vectors, not the product of both sides' blocks."""
    monkeypatch.setattr(nearest_plan, "CHUNK_ROWS", 100)
    monkeypatch.setattr(nearest_plan, "QUERY_ROWS", 10)
    own = np.random.default_rng(12)
    c, q = own.normal(size=(4000, 64)), own.normal(size=(40, 64))
    chunks, queries = frame(spark, "c", c).repartition(16), frame(spark, "q", q).repartition(2).withColumn("top_k", F.lit(3))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}

    chunks, queries = nearest_plan.stage(chunks), nearest_plan.stage(queries)
    before = shuffled()
    found = ids(nearest_plan.nearest(queries, chunks, ["document_id"], block_bytes=2_600))
    assert found == brute(q, c, [3] * 40, "cosine")
    assert sum(size for name, size in shuffled().items() if name not in before) < 3 * 4 * (c.size + q.size)
