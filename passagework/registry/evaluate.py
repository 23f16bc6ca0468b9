"""Evaluation of retrieved contexts and answers. Samples are the benchmark texts; the recorded answer is the nearest chunk."""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.operators import chunking, embedding, evaluation, flows, prompts, retrieval
from passagework.operators import judging as judges
from passagework.plans.stage import stage
from passagework.registry.base import load, query, sql_hashed, sql_words
from passagework.registry.chat import BLOCK_SQL
from passagework.registry.search import (
    COSINE_SQL, DIM, _vector_sql, named_documents, text_chunks, text_hits, text_hits_sql, vector_chunks, vector_queries,
)
from passagework.session import scratch_path
from passagework.sources.evalset import load_eval_set

QUESTION = "^[^.!?]*[.!?]?"
SAMPLES_SQL = f"""smp AS (SELECT item_id AS sample_id, regexp_extract(text, '{QUESTION}') AS user_input, text AS reference FROM benchmark),
res AS (SELECT query_id AS sample_id, rank, content FROM found),
ans AS (SELECT s.*, coalesce(r.content, '') AS response FROM smp s LEFT JOIN res r ON r.sample_id = s.sample_id AND r.rank = 1)"""


def _words(text):
    return f"list_distinct({sql_words(text)})"


def samples(spark, folder):
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("sample_id"), F.regexp_extract("text", QUESTION, 0).alias("user_input"), F.col("text").alias("reference")
    )


def results(spark, folder):
    hits = text_hits(spark, folder, retrieval.BATCH_TOP_K).select(F.col("query_id").alias("sample_id"), "rank", "content")
    return stage(hits, "results")


def answered(spark, folder, found):
    rows = samples(spark, folder)
    recorded = found.filter("rank = 1").select("sample_id", F.col("content").alias("completion"))
    return evaluation.eval_table(rows, found, prompts.attach_answers(rows, recorded, ["sample_id"]))


def similarity(table):
    """Cosine of the hashed answer and the hashed reference."""
    provider = embedding.hashing_provider(DIM)
    pair = table.select("sample_id", "response", "reference")
    said = embedding.embed_chunks(pair, provider, "h", text="response").withColumnRenamed("embedding", "a").drop("embedding_model")
    both = embedding.embed_chunks(said, provider, "h", text="reference")
    return both.select("sample_id", V.cosine(F.col("a"), F.col("embedding")).alias("similarity"))


@query(
    "eval_table",
    f"""WITH {text_hits_sql(15)}, {SAMPLES_SQL}, c AS (SELECT sample_id, count(*) AS contexts,
 string_agg(content, chr(10) ORDER BY rank) AS joined FROM res GROUP BY sample_id)
SELECT sample_id, user_input, reference, coalesce(contexts, 0) AS contexts, coalesce(joined, '') AS joined, response FROM ans LEFT JOIN c USING (sample_id)""",
)
def eval_table(spark, folder):
    table = answered(spark, folder, results(spark, folder))
    return table.select(
        "sample_id", "user_input", "reference", F.size("retrieved_contexts").cast("bigint").alias("contexts"),
        F.array_join("retrieved_contexts", "\n").alias("joined"), "response",
    )


RECALL_SQL = f"""sent AS (SELECT sample_id, generate_subscripts(ss, 1) AS no, unnest(ss) AS sentence FROM
  (SELECT sample_id, regexp_extract_all(reference, '{chunking.SENTENCES_AND_LINES}') AS ss FROM smp)),
sw AS (SELECT sample_id, no, {_words('sentence')} AS words FROM sent),
cw AS (SELECT sample_id, rank, {_words('content')} AS words FROM res),
sup AS (SELECT s.sample_id, s.no, max(CASE WHEN len(list_intersect(s.words, c.words)) >= 0.6 * len(s.words) THEN 1 ELSE 0 END) AS supported
  FROM sw s JOIN cw c ON s.sample_id = c.sample_id WHERE len(s.words) > 0 GROUP BY ALL),
recall AS (SELECT sample_id, coalesce(avg(supported), 0) AS context_recall FROM smp LEFT JOIN sup USING (sample_id) GROUP BY sample_id)"""


@query("context_recall", f"WITH {text_hits_sql(15)}, {SAMPLES_SQL}, {RECALL_SQL} SELECT sample_id, round(context_recall, 6) AS context_recall FROM recall")
def context_recall(spark, folder):
    verdicts = evaluation.support_verdicts(samples(spark, folder), results(spark, folder))
    return evaluation.context_recall(verdicts, samples(spark, folder)).withColumn("context_recall", F.round("context_recall", 6))


@query(
    "context_precision",
    f"""WITH {_vector_sql(COSINE_SQL, 'score DESC', '15')},
v AS (SELECT query_id, rank, CASE WHEN q_label = c_label THEN 1 ELSE 0 END AS rel FROM hits),
p AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS precision FROM v)
SELECT query_id AS sample_id, round(coalesce(sum(precision * rel) / nullif(sum(rel), 0), 0), 6) AS context_precision FROM p GROUP BY query_id""",
)
def context_precision(spark, folder):
    """Every vector is a query; a result is relevant when it has the query's label."""
    queries, chunks = vector_queries(spark, folder), vector_chunks(spark, folder)
    hits = retrieval.search(queries, chunks, k=retrieval.BATCH_TOP_K)
    judged = hits.join(queries.select("query_id", F.col("label").alias("wanted")), "query_id").join(
        chunks.select("document_id", "label"), "document_id"
    )
    verdicts = judged.select(
        F.col("query_id").alias("sample_id"), "rank", (F.col("wanted") == F.col("label")).cast("int").alias("relevant")
    )
    return evaluation.context_precision(verdicts).withColumn("context_precision", F.round("context_precision", 6))


CORRECT_SQL = f"""aw AS (SELECT sample_id, {_words('response')} AS a, {_words('reference')} AS r FROM ans),
facts AS (SELECT sample_id, len(list_intersect(a, r)) AS tp, len(a) - len(list_intersect(a, r)) AS fp, len(r) - len(list_intersect(a, r)) AS fn FROM aw),
answer_t AS (SELECT sample_id, response AS text FROM ans), reference_t AS (SELECT sample_id, reference AS text FROM ans),
{sql_hashed('answer_t', 'sample_id', DIM, 'ah')}, {sql_hashed('reference_t', 'sample_id', DIM, 'rh')},
an AS (SELECT sample_id, sqrt(sum(w * w)) AS n FROM ah GROUP BY ALL), rn AS (SELECT sample_id, sqrt(sum(w * w)) AS n FROM rh GROUP BY ALL),
dot AS (SELECT ah.sample_id, sum(ah.w * rh.w) AS d FROM ah JOIN rh ON ah.sample_id = rh.sample_id AND ah.b = rh.b GROUP BY ALL),
correct AS (SELECT f.sample_id, 0.75::DOUBLE * coalesce(tp / nullif(tp + (fp + fn) / 2.0::DOUBLE, 0), 0)
  + 0.25::DOUBLE * coalesce(d / (an.n * rn.n), 0) AS answer_correctness
  FROM facts f LEFT JOIN dot USING (sample_id) LEFT JOIN an USING (sample_id) LEFT JOIN rn USING (sample_id))"""


@query(
    "answer_correctness",
    f"WITH {text_hits_sql(15)}, {SAMPLES_SQL}, {CORRECT_SQL} SELECT sample_id, round(answer_correctness, 6) AS answer_correctness FROM correct",
)
def answer_correctness(spark, folder):
    table = answered(spark, folder, results(spark, folder))
    scores = evaluation.answer_correctness(evaluation.fact_counts(table), similarity(table))
    return scores.withColumn("answer_correctness", F.round("answer_correctness", 6))


PRECISION_SQL = f"""rw AS (SELECT sample_id, {_words('reference')} AS words FROM smp),
rv AS (SELECT c.sample_id, c.rank, CASE WHEN len(list_intersect(r.words, c.words)) >= 0.6 * len(r.words) THEN 1 ELSE 0 END AS rel
  FROM cw c JOIN rw r ON r.sample_id = c.sample_id),
rp AS (SELECT *, sum(rel) OVER (PARTITION BY sample_id ORDER BY rank) / rank::DOUBLE AS precision FROM rv),
prec AS (SELECT sample_id, coalesce(sum(precision * rel) / nullif(sum(rel), 0), 0) AS context_precision FROM smp LEFT JOIN rp USING (sample_id) GROUP BY sample_id)"""


@query(
    "eval_report",
    f"""WITH {text_hits_sql(15)}, {SAMPLES_SQL}, {RECALL_SQL}, {PRECISION_SQL}, {CORRECT_SQL},
a AS (SELECT sample_id, user_input, context_recall, context_precision, answer_correctness FROM smp
  JOIN recall USING (sample_id) JOIN prec USING (sample_id) JOIN correct USING (sample_id))
SELECT sample_id, user_input, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision,
 round(answer_correctness, 6) AS answer_correctness FROM a
UNION ALL SELECT NULL, NULL, round(avg(context_recall), 6), round(avg(context_precision), 6), round(avg(answer_correctness), 6) FROM a""",
)
def eval_report(spark, folder):
    rows, found = samples(spark, folder), results(spark, folder)
    table = answered(spark, folder, found)
    report = evaluation.eval_report(
        rows,
        evaluation.context_recall(evaluation.support_verdicts(rows, found), rows),
        evaluation.context_precision(evaluation.relevance_verdicts(rows, found), rows),
        evaluation.answer_correctness(evaluation.fact_counts(table), similarity(table)),
    )
    names = ("context_recall", "context_precision", "answer_correctness")
    return report.select("sample_id", "user_input", *[F.round(n, 6).alias(n) for n in names])


#: Items in one file of the evaluation set.
PER_FILE = 16
FILE_SAMPLES_SQL = f"""smp AS (SELECT DISTINCT md5(user_input || '|' || reference) AS sample_id, user_input, reference
  FROM (SELECT regexp_extract(text, '{QUESTION}') AS user_input, text AS reference FROM benchmark)),
items AS (SELECT sample_id AS query_id, user_input AS text FROM smp)"""
FILE_ANSWERS_SQL = f"""res AS (SELECT query_id AS sample_id, rank, content FROM found),
ctx AS (SELECT query_id AS sample_id, {BLOCK_SQL} AS context FROM found GROUP BY query_id),
ans AS (SELECT s.*, substring('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || user_input, 10) AS response
  FROM smp s LEFT JOIN ctx USING (sample_id))"""


@query(
    "eval_from_file",
    f"""WITH {text_hits_sql(15, items=FILE_SAMPLES_SQL)}, {FILE_ANSWERS_SQL}, {RECALL_SQL}, {PRECISION_SQL}, {CORRECT_SQL},
a AS (SELECT sample_id, user_input, context_recall, context_precision, answer_correctness FROM smp
  JOIN recall USING (sample_id) JOIN prec USING (sample_id) JOIN correct USING (sample_id))
SELECT sample_id, user_input, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision,
 round(answer_correctness, 6) AS answer_correctness FROM a
UNION ALL SELECT NULL, NULL, round(avg(context_recall), 6), round(avg(context_precision), 6), round(avg(answer_correctness), 6) FROM a""",
)
def eval_from_file(spark, folder):
    """The benchmark as JSON files of samples, read back, searched and judged; an answer is all that its prompt says after its first line: context and question."""
    path = scratch_path(spark, "evaluation-set")
    rows = samples(spark, folder).withColumn("file", F.floor(F.col("sample_id") / PER_FILE))
    lists = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("user_input", "reference"))).alias("value"))
    lists.write.partitionBy("file").text(path)
    loaded = load_eval_set(spark, f"{path}/file=*").distinct()
    named = stage(loaded.withColumn("sample_id", F.md5(F.concat_ws("|", "user_input", "reference"))), "samples")

    def echo(prompted):
        return prompted.select("sample_id", F.expr("substr(prompt, 10)").alias("completion"))

    chunks, documents = text_chunks(spark, folder), named_documents(spark, folder)
    report = flows.evaluate_samples(named, chunks, documents, embedding.hashing_provider(DIM), "hashing", echo)
    scores = ("context_recall", "context_precision", "answer_correctness")
    return report.select("sample_id", "user_input", *[F.round(n, 6).alias(n) for n in scores])


def _verbatim():
    """A second judge: a statement holds if the context has it word for word. It leaves out every third answer of a request."""
    def judge(pairs):
        return [(i, int(statement in context)) for i, (statement, context) in enumerate(pairs) if i % 3 or len(pairs) < 4]

    return judge


@query(
    "eval_second_judge",
    f"""WITH {text_hits_sql(15)}, {SAMPLES_SQL}, {RECALL_SQL.split('sup AS')[0]}
sup AS (SELECT s.sample_id, s.no, max(CASE WHEN contains(r.content, s.sentence) THEN 1 ELSE 0 END) AS supported
  FROM sent s JOIN sw USING (sample_id, no) JOIN res r ON s.sample_id = r.sample_id WHERE len(sw.words) > 0 GROUP BY ALL),
recall AS (SELECT sample_id, coalesce(avg(supported), 0) AS context_recall FROM smp LEFT JOIN sup USING (sample_id) GROUP BY sample_id),
rv AS (SELECT r.sample_id, r.rank, CASE WHEN contains(r.content, s.reference) THEN 1 ELSE 0 END AS rel FROM res r JOIN smp s USING (sample_id)),
rp AS (SELECT *, sum(rel) OVER (PARTITION BY sample_id ORDER BY rank) / rank::DOUBLE AS precision FROM rv),
prec AS (SELECT sample_id, coalesce(sum(precision * rel) / nullif(sum(rel), 0), 0) AS context_precision FROM smp LEFT JOIN rp USING (sample_id) GROUP BY sample_id)
SELECT sample_id, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision FROM recall JOIN prec USING (sample_id)""",
)
def eval_second_judge(spark, folder):
    """The samples judged word for word by an injected judge, with its verdicts kept."""
    rows, found = samples(spark, folder), stage(results(spark, folder), "results")
    judging = judges.Judging(_verbatim, "verbatim", scratch_path(spark, "verdicts"), size=16, attempts=8)
    recall = evaluation.context_recall(judges.support_verdicts(rows, found, judging, "support"), rows)
    precision = evaluation.context_precision(judges.relevance_verdicts(rows, found, judging, "relevance"), rows)
    both = recall.join(precision, "sample_id")
    return both.select("sample_id", *[F.round(n, 6).alias(n) for n in ("context_recall", "context_precision")])
