import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.operators import chunking, embedding
from passagework.operators.chunking import number_chunks, recursive_chunks


def _runs(items, joins):
    out = []
    for n, t in items:
        if out and joins(out[-1][0], n, out[-1][1], t):
            out[-1] = (out[-1][0] + n, out[-1][1] + t)
        else:
            out.append((n, t))
    return out


def plain_chunks(text, size, least, measure=len):
    """The chunking contract, stated without Spark."""
    found = [(measure(text), text)]
    for level in chunking.LEVELS:
        pattern, parts = re.compile(level.replace(r"\z", r"\Z")), []
        for n, t in found:
            if n <= size:
                parts.append((n, t))
            else:
                pieces = [(measure(p), p) for p in (m.group() for m in pattern.finditer(t))]
                parts += _runs(pieces, lambda a, n, *_: a + n <= size)
        found = parts
    if measure is len:
        found = [(len(p), p) for n, t in found for p in ([t] if n <= size else [t[i : i + size] for i in range(0, n, size)])]
    return [t for _, t in _runs(found, lambda a, n, x, y: (len(x) < least or len(y) < least) and a + n <= size)]


def run(spark, texts, size, least=24, **kw):
    rows = [(i, 1, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "document_id long, page_number int, content string")
    got = {}
    for r in recursive_chunks(pages, size, least, **kw).orderBy("document_id", "piece_no").collect():
        assert texts[r.document_id][r.start_index : r.end_index] == r.text
        got.setdefault(r.document_id, []).append(r)
    return got


EDGES = [
    "One paragraph.\n\nAnother one, longer.\n\n\nThird after three line ends.",
    "\n\nLeading and trailing blank lines.\n\n",
    "\n\n\nabc\n\ndef",
    "x" * 1000,
    "word " * 200,
    "Sentence one. Sentence two!  Sentence three? " * 20,
    "Satır İ ve ı harfleri 😀😀 ile. " * 15,
    "no end\nshort\n" * 30,
    "a.b.c.d" * 40,
    ". . . .!?!? " * 30,
    "\x0bvertical\x0b tab. " * 12,
]


@pytest.mark.parametrize("size,least", [(7, 3), (40, 24), (64, 1), (256, 24), (2048, 24)])
def test_matches_plain_statement(spark, size, least):
    got = run(spark, EDGES, size, least)
    for i, text in enumerate(EDGES):
        assert [r.text for r in got[i]] == plain_chunks(text, size, least)
        assert all(r.token_count == len(r.text) <= size for r in got[i])
        assert "".join(r.text for r in got[i]) == text


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\té😀", min_size=1, max_size=200), min_size=1, max_size=20), st.integers(2, 60), st.integers(1, 30))
def test_random_texts(spark, texts, size, least):
    texts = [t for t in texts if t.strip()]
    if texts:
        got = run(spark, texts, size, least)
        assert {i: [r.text for r in rows] for i, rows in got.items()} == {
            i: plain_chunks(t, size, least) for i, t in enumerate(texts)
        }


def test_very_long_page_spans_segments(spark):
    text = "Short one. " * 30_000
    got = run(spark, [text], 20, 1)[0]
    assert len(got) == 30_000 and "".join(r.text for r in got) == text


def test_sizes_in_tokens(spark):
    from passagework.functions.tokens import _tokenizer, default_vocabulary

    tokenizer = _tokenizer(default_vocabulary())

    def tokens(t):
        return len(tokenizer.encode(t, add_special_tokens=False).ids)

    got = run(spark, EDGES, 16, 5, tokenizer="gpt2")
    for i, text in enumerate(EDGES):
        assert "".join(r.text for r in got[i]) == text
        if "x" * 100 not in text and "a.b" not in text:
            assert [r.text for r in got[i]] == plain_chunks(text, 16, 5, tokens)
        assert all(r.token_count <= 16 for r in got[i])


def test_blank_pages_give_no_chunk(spark):
    rows = [(1, i, t) for i, t in enumerate([" ", "\n", "  ", "", None, "x"])]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, content string")
    assert [r.text for r in recursive_chunks(pages).collect()] == ["x"]


def test_ordinals_are_dense_even_for_one_huge_document(spark):
    pages = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("document_id"),
        F.col("id").cast("int").alias("page_number"), F.lit("Ab. Cd.").alias("content"),
    )
    rows = number_chunks(recursive_chunks(pages, 4, 1)).groupBy("document_id").agg(
        F.count("*").alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"),
        F.countDistinct("chunk_index").alias("distinct"),
    )
    assert rows.filter("low <> 0 OR high <> n - 1 OR distinct <> n").count() == 0
    numbered = number_chunks(recursive_chunks(pages.filter("document_id = 1"), 4, 1)).orderBy("page_number", "start_index")
    assert [r.chunk_index for r in numbered.collect()] == list(range(numbered.count()))


def test_batches(spark):
    with pytest.raises(ValueError):
        embedding.check_batch_size(0)
    with pytest.raises(ValueError):
        embedding.check_batch_size(2049)
    rows = embedding.assign_batches(spark.createDataFrame([(1, i) for i in range(5)], "document_id int, chunk_index int"), 2)
    assert [(r.batch_no, r.batch_pos) for r in rows.orderBy("chunk_index").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_provider_answers_are_aligned_by_index(spark):
    def reversed_provider():
        return lambda texts: [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 40)], "id int, text string")
    out = embedding.embed_chunks(rows, reversed_provider, "m", size=7).collect()
    assert all(r.embedding == [float(r.id), 0.0] and r.embedding_model == "m" for r in out)


def test_provider_must_answer_every_input(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="one vector per input"):
        embedding.embed_chunks(rows, lambda: lambda texts: [(0, [1.0])], "m").collect()


def test_refused_configs(spark):
    pages = spark.createDataFrame([(1, 1, "Some text here.", "p")], "document_id int, page_number int, content string, parser string")
    configs = spark.createDataFrame(
        [("a", "p", "recursive", "gpt2", 2, 1), ("b", "p", "semantic", None, None, None), ("c", "p", None, None, None, None)],
        "config_hash string, parser string, chunking_method string, tokenizer string, chunk_size int, min_characters_per_chunk int",
    )
    chunks, refused = chunking.chunk_with_configs(pages, configs)
    assert {r.config_hash for r in refused.collect()} == {"b", "c"}
    assert "".join(r.text for r in chunks.orderBy("piece_no").collect()) == "Some text here."


def test_numbering_before_the_rows_equals_numbering_after(spark):
    texts = ["One two. Three four five. " * n for n in range(1, 9)] + ["", "   ", None]
    rows = [(d, p, t) for d in range(3) for p, t in enumerate(texts)] + [(None, 0, texts[3])]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, content string").withColumn("other", F.lit("x")).repartition(4)
    one = chunking.number_chunks(chunking.recursive_chunks(pages, 40)).collect()
    two = chunking.numbered_chunks(pages, 40)
    columns = ["document_id", "page_number", "other", "piece_no", "text", "start_index", "end_index", "token_count", "chunk_index"]
    known = lambda found: sorted((tuple(r[c] for c in columns) for r in found if r.document_id is not None))
    assert two.columns == columns and known(two.collect()) == known(one)


def test_tokens_are_counted_in_bounded_batches(monkeypatch):
    from types import SimpleNamespace

    from passagework.functions import tokens

    seen = []

    def encode_batch(texts, add_special_tokens):
        seen.append(sum(map(len, texts)))
        return [SimpleNamespace(ids=t.split()) for t in texts]

    texts = ["a b c"] * 500 + ["", "x " * 400] + ["d e"] * 7
    monkeypatch.setattr(tokens, "ENCODED_CHARS", 100, raising=False)
    assert tokens._sizes(SimpleNamespace(encode_batch=encode_batch), texts) == [len(t.split()) for t in texts]
    assert max(seen) < 100 + 800 and sum(seen) == sum(map(len, texts)) and tokens._sizes(None, []) == []


def test_pieces_are_computed_once_a_page(spark):
    """No filter before the rows of the pieces computes all pieces again."""
    from pyspark.sql import functions as F

    pages = spark.range(1).select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.expr("repeat('One two. ', 100 + id)").alias("content"))
    chunks = chunking.recursive_chunks(pages, 64)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_zip") == 1 and chunks.count() == len(plain_chunks("One two. " * 100, 64, 24, len))
    none = spark.createDataFrame([(1, [])], "id int, __packed array<struct<__pieces:struct<length:int,text:string>,__starts:int>>")
    assert chunking._unpacked(none).count() == 0


def test_words_are_encoded_once_and_counts_stay_those_of_whole_texts():
    import random
    from types import SimpleNamespace

    from passagework.functions import tokens

    tokenizer = tokens._tokenizer(tokens.default_vocabulary())
    own, parts = random.Random(3), ["a", "b", "Zé", "22", " ", "  ", " ", "\n", "\n\n", "\t", "\x1c", "\x85", ".", "'s", "'", "!?", "<|endoftext|>", "<|endof", "漢字", "🙂", "\r\n"]
    texts = ["".join(own.choices(parts, k=own.randint(0, 12))) for _ in range(20_000)]
    counts = tokens._Counter(tokenizer)
    assert counts.apart and counts(texts) == tokens._sizes(tokenizer, texts)
    seen = []

    def encode(text, **options):
        seen.append(text)
        return tokenizer.encode(text, **options)

    counts = tokens._Counter(tokenizer)
    counts.bare.tokenizer = counts.after_blank.tokenizer = SimpleNamespace(encode=encode)
    text = "One two. Three two.\nOne two. "
    assert counts([text] * 9 + ["two.", "Three two. "]) == tokens._sizes(tokenizer, [text] * 9 + ["two.", "Three two. "])
    assert len(seen) == len(set(seen)) and sum(map(len, seen)) < 2 * len(text)
