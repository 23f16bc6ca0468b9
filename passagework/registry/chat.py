"""Contexts, prompts, conversations, responses."""
from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions.text import truncate_text as cut_text
from passagework.operators import conversations, embedding, flows, prompts, retrieval
from passagework.registry.base import load, query, sql_hashed_topk
from passagework.registry.search import (
    COSINE_SQL, DIM, _vector_sql, named_documents, text_chunks, text_hits, text_hits_sql, vector_chunks, vector_queries,
)

BLOCK_SQL = (
    "string_agg('[' || rank || '] (' || file_name || ', p.' || page_number || ')' || chr(10) || content,"
    " chr(10) || chr(10) ORDER BY rank)"
)


@query("context_block", f"WITH {text_hits_sql(5)} SELECT query_id, {BLOCK_SQL} AS context FROM found GROUP BY query_id")
def context_block(spark, folder):
    return prompts.format_context(text_hits(spark, folder, retrieval.CHAT_TOP_K))


@query(
    "plain_context",
    f"WITH {text_hits_sql(5)} SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context FROM found GROUP BY query_id",
)
def plain_context(spark, folder):
    return prompts.plain_context(text_hits(spark, folder, retrieval.CHAT_TOP_K))


@query(
    "answer_prompt",
    f"""WITH {text_hits_sql(5)}, c AS (SELECT query_id, {BLOCK_SQL} AS context FROM found WHERE query_id NOT IN
 (SELECT item_id FROM benchmark WHERE contains(text, chr(10))) GROUP BY query_id)
SELECT item_id AS query_id, text AS question, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text AS prompt
FROM benchmark LEFT JOIN c ON item_id = query_id""",
)
def answer_prompt(spark, folder):
    """Questions with a line break get no context, so that the empty wrapping shows."""
    questions = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    plain = questions.filter(~F.col("question").contains("\n")).select("query_id")
    contexts = prompts.format_context(text_hits(spark, folder, retrieval.CHAT_TOP_K)).join(plain, "query_id", "left_semi")
    return prompts.answer_prompt(questions, contexts)


@query(
    "conversation_history",
    """SELECT conv_id, turn, count(*) OVER w AS messages, string_agg(role || ': ' || text, chr(10)) OVER w AS history
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def conversation_history(spark, folder):
    turns = conversations.history(load(spark, folder, "conversations"), ["conv_id"], width=3)
    line = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return turns.select(
        "conv_id", "turn", F.size("history").cast("bigint").alias("messages"), F.array_join(line, "\n").alias("history")
    )


@query(
    "request_messages",
    f"""WITH t AS (SELECT *, CASE WHEN length(text) > 150 THEN 'ctx ' || conv_id WHEN length(text) > 100 THEN '' END AS context FROM conversations),
p AS (SELECT *, coalesce(string_agg(role || '=' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10), '') AS past FROM t)
SELECT conv_id, turn, 'system={prompts.SYSTEM_PROMPT}' || chr(10) || past || 'user=' || CASE WHEN coalesce(context, '') <> ''
 THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text ELSE text END AS messages FROM p WHERE role = 'user'""",
)
def request_messages(spark, folder):
    """Contexts follow the length of the question: present, empty, or missing."""
    turns = load(spark, folder, "conversations")
    size = F.length("text")
    contexts = turns.filter(size > 100).select(
        "conv_id", "turn", F.when(size > 150, F.concat(F.lit("ctx "), F.col("conv_id").cast("string"))).otherwise("").alias("context")
    )
    built = conversations.request_messages(turns, contexts, ["conv_id"])
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return built.select("conv_id", "turn", F.array_join(line, "\n").alias("messages"))


@query(
    "first_turn_prompt",
    f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user'),
items AS (SELECT conv_id AS query_id, text FROM u WHERE nth = 1), ch AS (SELECT doc_id AS document_id, text FROM documents),
{sql_hashed_topk('1', DIM, 'items', keys='document_id')},
best AS (SELECT query_id AS conv_id, d.text AS best_text FROM hits JOIN documents d ON document_id = doc_id WHERE score > 0)
SELECT u.conv_id, u.turn, CASE WHEN nth = 1 THEN 'SOURCES: Most relevant documents: ' || coalesce(best_text, '') || chr(10)
 || ' User query: ' || u.text ELSE u.text END AS prompt FROM u LEFT JOIN best ON u.conv_id = best.conv_id""",
)
def first_turn_prompt(spark, folder):
    turns = load(spark, folder, "conversations")
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    provider = embedding.hashing_provider(DIM)
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = retrieval.best_match(
        embedding.embed_chunks(first.withColumnRenamed("conv_id", "query_id"), provider, "hashing"),
        embedding.embed_chunks(docs, provider, "hashing"),
        "document_id",
    )
    best = found.join(docs, "document_id").select(F.col("query_id").alias("conv_id"), F.col("text").alias("best_text"))
    return prompts.first_turn_prompt(turns, best)


def commanded_turns(spark, folder):
    """User turns by first letter: E resets, O exits, I lists sources, H is blank, A has blanks around it."""
    first, text = F.substring("text", 1, 1), F.col("text")
    typed = (
        F.when(first == "E", " /reset").when(first == "O", "/exit").when(first == "I", "/sources\n").when(first == "H", " \t")
        .when(first == "A", F.concat(F.lit("\n "), text, F.lit("\t"))).otherwise(text)
    )
    user = F.col("role") == "user"
    return load(spark, folder, "conversations").withColumn("text", F.when(user, typed).otherwise(text))


SEGMENTS_SQL = """typed AS (SELECT conv_id, turn, role, text, CASE WHEN role <> 'user' THEN role WHEN text LIKE 'E%' THEN 'reset'
  WHEN text LIKE 'O%' THEN 'exit' WHEN text LIKE 'I%' THEN 'sources' ELSE 'question' END AS kind
  FROM conversations WHERE NOT (role = 'user' AND text LIKE 'H%')),
counted AS (SELECT *, sum(CASE kind WHEN 'exit' THEN 1 ELSE 0 END) OVER w AS exits,
  CAST(sum(CASE kind WHEN 'reset' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment,
  CAST(sum(CASE kind WHEN 'question' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS question_no
  FROM typed WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
seg AS (SELECT conv_id, turn, role, CASE kind WHEN 'sources' THEN '/sources' ELSE text END AS text, kind, segment, question_no
  FROM counted WHERE exits = 0 AND kind <> 'reset')"""


@query("command_segments", f"WITH {SEGMENTS_SQL} SELECT conv_id, turn, role, text, kind, segment, question_no FROM seg")
def command_segments(spark, folder):
    """Leading and trailing blanks of the typed text are gone afterwards (the source texts have none)."""
    return conversations.segment_conversations(commanded_turns(spark, folder))


@query(
    "last_sources",
    f"""WITH {SEGMENTS_SQL}, {_vector_sql(COSINE_SQL, 'score DESC', where='c.vec_id IN (SELECT doc_id FROM documents)')},
found AS (SELECT s.conv_id, s.segment, s.question_no, h.rank, d.source || '/' || d.doc_id ||
   CASE WHEN h.c_label > 0 THEN ', p.' || h.c_label ELSE '' END AS location, round(h.score, 3) AS score
  FROM seg s JOIN hits h ON h.query_id = s.conv_id + s.turn JOIN documents d ON d.doc_id = h.document_id WHERE s.kind = 'question')
SELECT s.conv_id, s.turn, f.rank, f.location, f.score FROM seg s LEFT JOIN found f USING (conv_id, segment, question_no) WHERE s.kind = 'sources'""",
)
def last_sources(spark, folder):
    """A question's vector is the one numbered conversation + turn; the page of a chunk is its label, none for label 0."""
    segments = conversations.segment_conversations(commanded_turns(spark, folder))
    page = F.when(F.col("label") > 0, F.concat(F.lit('{"page_number":'), F.col("label").cast("string"), F.lit("}"))).otherwise("{}")
    chunks = vector_chunks(spark, folder).withColumn("metadata", page)
    hits = retrieval.search(vector_queries(spark, folder), chunks, named_documents(spark, folder), 5)
    asked = segments.filter("kind = 'question'").select("conv_id", "turn", (F.col("conv_id") + F.col("turn")).alias("query_id"))
    return conversations.last_sources(segments, asked.join(hits, "query_id"))


ASKED_SQL = "items AS (SELECT conv_id || ':' || turn AS query_id, text FROM seg WHERE kind = 'question')"


@query(
    "chat_requests",
    f"""WITH {SEGMENTS_SQL}, {text_hits_sql(5, items=ASKED_SQL)},
c AS (SELECT query_id, {BLOCK_SQL} AS context FROM found GROUP BY query_id),
p AS (SELECT *, coalesce(string_agg(role || '=' || text, chr(10)) OVER (PARTITION BY conv_id, segment ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10), '') AS past FROM seg WHERE kind <> 'sources')
SELECT conv_id, segment, turn, 'system={prompts.SYSTEM_PROMPT}' || chr(10) || past || 'user=' || CASE WHEN context IS NOT NULL
 THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text ELSE text END AS messages
FROM p LEFT JOIN c ON query_id = conv_id || ':' || turn WHERE kind = 'question'""",
)
def chat_requests(spark, folder):
    """Conversations with commands against all documents: real retrieved contexts, history cut at every reset."""
    requests, _ = flows.chat_requests(
        commanded_turns(spark, folder), text_chunks(spark, folder), named_documents(spark, folder), embedding.hashing_provider(DIM), "hashing"
    )
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return requests.select("conv_id", "segment", "turn", F.array_join(line, "\n").alias("messages"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '… [+' || (length(text) - 800) || ' chars]' ELSE text END AS shown FROM documents",
)
def truncate_text(spark, folder):
    return load(spark, folder, "documents").select("doc_id", cut_text(F.col("text")).alias("shown"))


@query(
    "prompt_routing",
    """SELECT item_id, CASE WHEN contains(text, 'than') THEN 'deny' ELSE 'generate' END AS branch,
 CASE WHEN contains(text, 'than') THEN 'Denied' END AS output FROM benchmark""",
)
def prompt_routing(spark, folder):
    routed = prompts.route_prompts(load(spark, folder, "benchmark"), "than", "text")
    return routed.select("item_id", "branch", "output")


@query(
    "attach_answers",
    f"""SELECT u.conv_id, u.turn, coalesce(a.text, '{prompts.NO_MESSAGE}') AS answer FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
)
def attach_answers(spark, folder):
    """Recorded answers are the following assistant turns, stored with blanks around them."""
    turns = load(spark, folder, "conversations")
    said = F.concat(F.lit(" \n"), F.col("text"), F.lit("\t "))
    recorded = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), said.alias("completion"))
    asked = turns.filter("role = 'user'").select("conv_id", "turn")
    return prompts.attach_answers(asked, recorded, ["conv_id", "turn"], prompts.NO_MESSAGE, strip=True)


@query(
    "query_responses",
    f"""WITH {text_hits_sql(5)}, s AS (SELECT query_id, count(*) AS n, string_agg(file_name || '#' || chunk_index, ' ' ORDER BY rank) AS names
 FROM found WHERE score > 0.7 GROUP BY query_id)
SELECT item_id AS request_id, CASE WHEN contains(text, chr(10)) THEN '' ELSE text END AS answer, coalesce(n, 0) AS sources,
 coalesce(names, '') AS names FROM benchmark LEFT JOIN s ON item_id = query_id""",
)
def query_responses(spark, folder):
    """Requests without a recorded answer or without a source above the bar still get a response."""
    items = load(spark, folder, "benchmark").withColumnRenamed("item_id", "request_id")
    answers = items.filter(~F.col("text").contains("\n")).withColumnRenamed("text", "answer")
    hits = text_hits(spark, folder, 5).filter("score > 0.7").withColumnRenamed("query_id", "request_id")
    out = retrieval.responses(items, answers, retrieval.accumulate_sources(hits.withColumn("call_no", F.lit(0))))
    name = F.transform("sources", lambda s: F.concat(s["file_name"], F.lit("#"), s["chunk_index"].cast("string")))
    return out.select(
        "request_id", "answer", F.size("sources").cast("bigint").alias("sources"), F.array_join(name, " ").alias("names")
    )


@query(
    "running_counter",
    "SELECT event_id, user_id, 5 + count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter FROM events",
)
def running_counter(spark, folder):
    counted = conversations.running_counter(load(spark, folder, "events"), "user_id", "ts", "event_id", start=5)
    return counted.select("event_id", "user_id", "counter")
