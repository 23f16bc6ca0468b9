import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagework.operators import conversations as C
from passagework.operators import embedding, evaluation, prompts
from passagework.operators import judging as judges
from passagework.operators.ingest import current_documents, stored_chunks, stored_configs
from passagework.plans.running import BLOCK, number_blocks, range_blocks, running_sums
from passagework.registry.store import RUN, RUN_COLUMNS
from passagework.sources import files, markup
from passagework.streaming import counter, ingest


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_running_sums_equal_a_plain_window_with_a_hot_key(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k"),  # some keys are null
        F.when(F.col("id") > 0, F.col("id")).alias("seq"), (F.col("id") % 5).alias("v"),
    )
    for inclusive, end in ((True, 0), (False, -1)):
        window = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, end)
        plain = rows.withColumn("s", F.coalesce(F.sum("v").over(window), F.lit(0)))
        ours = running_sums(rows, ["k"], ["seq"], number_blocks(F.col("seq"), 100), {"s": F.col("v")}, inclusive)
        assert ours.count() == 30_000 and ours.exceptAll(plain).count() == 0


def test_history_across_blocks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)] + [(2, 5, "user", "only"), (None, 0, "user", "no id")]
    got = C.history(turns(spark, rows), ["conv_id"], width=4)
    by = {(r.conv_id, r.turn): [m.text for m in r.history] for r in got.collect()}
    assert by[(2, 5)] == ["only"] and by[(None, 0)] == ["no id"] and all(by[(1, i)] == [f"t{j}" for j in range(i + 1)] for i in range(40))


def test_context_goes_to_the_last_user_message_only(spark):
    df = turns(spark, [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")])
    contexts = spark.createDataFrame([(1, 0, "c1"), (1, 2, "c2")], "conv_id int, turn int, context string")
    got = {r.turn: [(m.role, m.content) for m in r.messages] for r in C.request_messages(df, contexts, ["conv_id"], "sys").collect()}
    assert got == {
        0: [("system", "sys"), ("user", "Context:\nc1\n\nQuestion: q1")],
        2: [("system", "sys"), ("user", "q1"), ("assistant", "a1"), ("user", "Context:\nc2\n\nQuestion: q2")],
    }


def test_commands(spark):
    rows = [
        (1, 0, "user", "  first  "), (1, 1, "assistant", " kept as is "), (1, 2, "user", "  "), (1, 3, "user", "/sources"),
        (1, 4, "user", " /reset\n"), (1, 5, "user", "/sources"), (1, 6, "user", "second"), (1, 7, "user", "/exit"), (1, 8, "user", "never"),
    ]
    segments = C.segment_conversations(turns(spark, rows))
    got = [(r.turn, r.text, r.kind, r.segment, r.question_no) for r in segments.orderBy("turn").collect()]
    assert got == [
        (0, "first", "question", 0, 1), (1, " kept as is ", "assistant", 0, 1), (3, "/sources", "sources", 0, 1),
        (5, "/sources", "sources", 1, 1), (6, "second", "question", 1, 2),
    ]
    results = spark.createDataFrame(
        [(1, 0, 1, "f", 3, 0.12345), (1, 0, 2, "g", None, -0.5)], "conv_id int, turn int, rank int, file_name string, page_number int, score double"
    )
    listed = C.last_sources(segments, results).orderBy("turn", "rank").collect()
    assert [(r.turn, r.rank, r.location, r.score) for r in listed] == [(3, 1, "f, p.3", 0.123), (3, 2, "g", -0.5), (5, None, None, None)]


def test_context_blocks(spark):
    rows = [(1, 2, "b", None, "y"), (1, 1, "a", 4, "x")]
    df = spark.createDataFrame(rows, "query_id int, rank int, file_name string, page_number int, content string")
    assert prompts.format_context(df).first().context == "[1] (a, p.4)\nx\n\n[2] (b)\ny"
    assert prompts.plain_context(df).first().context == "x\n\ny"


def test_answers_and_routing(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    said = spark.createDataFrame([(1, "  yes \n"), (2, "")], "id int, completion string")
    got = {r.id: r.answer for r in prompts.attach_answers(asked, said, ["id"], prompts.NO_MESSAGE, strip=True).collect()}
    assert got == {1: "yes", 2: "(No Message)", 3: "(No Message)"}
    routed = prompts.route_prompts(spark.createDataFrame([("a pasta dish",), ("Pasta",)], "prompt string"), "pasta").collect()
    assert [(r.branch, r.output) for r in routed] == [("deny", "Denied"), ("generate", None)]


def test_first_turn_only_is_grounded(spark):
    df = turns(spark, [(1, 1, "user", "q1"), (1, 3, "user", "q2"), (2, 0, "user", "z")])
    best = spark.createDataFrame([(1, "text")], "conv_id int, best_text string")
    got = {(r.conv_id, r.turn): r.prompt for r in prompts.first_turn_prompt(df, best).collect()}
    assert got == {
        (1, 1): "SOURCES: Most relevant documents: text\n User query: q1", (1, 3): "q2",
        (2, 0): "SOURCES: Most relevant documents: \n User query: z",
    }


def test_counter_over_many_days_of_one_key(spark):
    events = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1_800).alias("ts"),
    )
    got = C.running_counter(events, "k", "ts", "id", start=5).filter("k = 1").orderBy("id")
    assert [r.counter for r in got.collect()] == [5 + i + 1 for i in range(got.count())]


def test_precision_and_recall(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "sample_id int, rank int, relevant int")
    got = {r.sample_id: r.context_precision for r in evaluation.context_precision(v).collect()}
    assert got[1] == pytest.approx((1 + 2 / 3) / 2) and got[2] == 0
    samples = spark.createDataFrame([(1, "One two three. Four five. ...")], "sample_id int, reference string")
    results = spark.createDataFrame([(1, 1, "two ONE"), (1, 2, "four")], "sample_id int, rank int, content string")
    verdicts = evaluation.support_verdicts(samples, results)
    assert [(r.sentence_no, r.supported) for r in verdicts.orderBy("sentence_no").collect()] == [(0, 1), (1, 0)]
    assert evaluation.context_recall(verdicts).first().context_recall == 0.5


def test_report_fails_on_a_missing_score_and_is_empty_for_no_samples(spark):
    samples = spark.createDataFrame([(1, "q"), (2, "r")], "sample_id int, user_input string")

    def scores(name, ids):
        return spark.createDataFrame([(i, 0.5) for i in ids], f"sample_id int, {name} double")

    full = [scores(n, [1, 2]) for n in ("context_recall", "context_precision", "answer_correctness")]
    rows = evaluation.eval_report(samples, *full).collect()
    assert len(rows) == 3 and [r.context_recall for r in rows if r.sample_id is None] == [0.5]
    with pytest.raises(Exception, match="no context_precision for sample 2"):
        evaluation.eval_report(samples, full[0], scores("context_precision", [1]), full[2]).collect()
    assert evaluation.eval_report(samples.limit(0), *full).count() == 0


def test_stream_ingest_replays_and_changes(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    handler = files.Handler("PlainHandler", "1", ("TEXT",), markup.text_pages)
    runs = spark.createDataFrame([RUN], RUN_COLUMNS)
    now = F.timestamp_seconds(F.lit(1_700_000_000))

    def run(checkpoint):
        stream = ingest.arriving_files(spark, str(src), (".txt",))
        ingest.stream_ingest(
            stream, out, str(tmp_path / checkpoint), [handler], runs, embedding.hashing_provider(64), 64, "m", {"txt": "TEXT"}, now
        ).awaitTermination()
        return sorted((r.document_id, r.chunk_index, r.content) for r in stored_chunks(spark, out).collect())

    def names():
        return {r.file_name for r in current_documents(spark, out).collect()}

    (src / "a.txt").write_text("One two. Three four.")
    (src / "b.txt").write_text("   ")
    (src / "no.bin").write_text("not read")
    first = run("one")
    assert "".join(t for _, _, t in first) == "One two. Three four."
    assert names() == {"a.txt"}
    row = stored_chunks(spark, out).first()
    assert '"page_number":1' in row.metadata and row.created_at is not None and stored_configs(spark, out).count() == 1
    assert run("one") == first and run("two") == first
    (src / "a.txt").write_text("New one. " * 40)
    (src / "c.txt").write_text("Cc.")
    after = run("three")
    kept = {(d, i): t for d, i, t in after}
    assert all(kept[(d, i)] == t for d, i, t in first) and len(after) > len(first)
    assert names() == {"a.txt", "c.txt"} and run("three") == after


def test_stream_counter(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for _ in range(2):
        spark.range(10).select((F.col("id") % 3).alias("k")).write.mode("append").parquet(src)
        counter.stream_counter(spark.readStream.schema("k bigint").parquet(src), "k", out, str(tmp_path / "cp"), start=1).awaitTermination()
    assert {r.k: r.counter for r in counter.latest_counters(spark, out, "k").collect()} == {0: 9, 1: 7, 2: 7}


def test_words_of_any_script_are_judged_and_no_word_scores_zero(spark):
    samples = spark.createDataFrame(
        [(1, "q", "Москва стоит. Çay içilir."), (2, "r", "..."), (3, "s", "Alone here.")], "sample_id int, user_input string, reference string"
    )
    results = spark.createDataFrame([(1, 1, "МОСКВА Москва стоит"), (1, 2, "çay"), (2, 1, "text")], "sample_id int, rank int, content string")
    recall = evaluation.context_recall(evaluation.support_verdicts(samples, results), samples)
    assert {r.sample_id: r.context_recall for r in recall.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    precision = evaluation.context_precision(evaluation.relevance_verdicts(samples, results), samples)
    correctness = samples.select("sample_id", F.lit(1.0).alias("answer_correctness"))
    rows = evaluation.eval_report(samples, recall, precision, correctness).collect()
    assert len(rows) == 4 and [round(r.context_recall, 6) for r in rows if r.sample_id is None] == [round(0.5 / 3, 6)]


def test_hashed_words_of_a_batch(spark):
    texts = ["Été ÉTÉ été x", None, "", "X x"]
    vectors = dict(embedding.hashing_provider(512)()(texts))
    assert abs(vectors[0]).sum() > 0 and not vectors[1].any() and not vectors[2].any()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in embedding.hashed_counts(rows, "t", 512).collect():
        assert dict(zip(r.bucket, r.weight)) == {i: int(v) for i, v in enumerate(vectors[r.id]) if v}
    assert vectors[3].tolist() == [2 * v for v in dict(embedding.hashing_provider(512)()(["x"]))[0].tolist()]


def test_a_busy_instant_spreads_over_blocks(spark):
    events = spark.range(5000).select((F.col("id") % 5 == 0).cast("int").alias("k"), F.timestamp_seconds(F.lit(7)).alias("ts"), (F.col("id") * 7 % 5003).alias("tie"))
    blocks = range_blocks(events, ["k", "ts", "tie"]).groupBy("k", BLOCK).count().collect()
    assert max(r["count"] for r in blocks) < 2000 and len({r[BLOCK] for r in blocks if r.k == 0}) > 2
    got = C.running_counter(events, "k", "ts", "tie", 10).collect()
    for k in (0, 1):
        mine = sorted((r.tie, r.counter) for r in got if r.k == k)
        assert [c for _, c in mine] == list(range(11, 11 + len(mine)))
    assert got[0].asDict().keys() == {"k", "ts", "tie", "counter"}


def test_a_judge_is_asked_once_per_content_and_must_answer(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def factory():
        def judge(pairs):
            asked.add(len(pairs))
            return [(i, int("yes" in c)) for i, (_, c) in enumerate(pairs)]

        return judge

    def silent():
        return lambda pairs: [(i, 1) for i in range(len(pairs) - 1)] if len(pairs) > 1 else []

    judging = judges.Judging(factory, "j", str(tmp_path))
    rows = [(1, "s", "yes"), (2, "s", "no"), (3, "s", "yes"), (4, None, "yes"), (5, "sy", "es"), (6, "", None)]
    pairs = spark.createDataFrame(rows, "id int, statement string, context string").withColumn("verdict_of", F.lit("x"))
    got = {r.id: r.verdict for r in judges.verdicts(pairs, judging, "a").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0} and asked.value == 5
    assert judges.verdicts(pairs.limit(3), judging, "b").count() == 3 and asked.value == 5
    assert judges.ask(lambda p: [(0, 1)], [("a", "b")] * 3, 3) == [1, 1, 1]
    with pytest.raises(Exception, match="no verdict on 1 pairs after 3 attempts"):
        judges.verdicts(pairs, judges.Judging(silent, "silent", str(tmp_path)), "c").count()
    samples = spark.createDataFrame([(1, "One here. Two there. ...")], "sample_id int, reference string")
    found = spark.createDataFrame([(1, 1, "yes"), (1, 2, "no")], "sample_id int, rank int, content string")
    assert sorted((r.sentence_no, r.supported) for r in judges.support_verdicts(samples, found, judging, "d").collect()) == [(0, 1), (1, 1)]
    assert sorted((r.rank, r.relevant) for r in judges.relevance_verdicts(samples, found, judging, "e").collect()) == [(1, 1), (2, 0)]
    assert judges.verdicts(pairs.limit(0), judging, "f").count() == 0
