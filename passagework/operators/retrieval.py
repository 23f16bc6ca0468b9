"""Top-k retrieval of chunks for whole query tables."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import vectors as V
from passagework.functions.metadata import page_number_of
from passagework.plans.checks import first_reason, split_on_reason
from passagework.plans.nearest import (
    BLOCK_BYTES,
    CELL_ROWS,
    MAX_BROADCAST_HITS,
    DenseVectors,
    SparseCounts,
    bucketed_nearest,
    nearest,
    nearest_sized,
)
from passagework.plans.stage import stage

# Default number of chunks for chat and direct search, and for evaluation and request tables.
CHAT_TOP_K = 5
BATCH_TOP_K = 15
#: Share of the lists that an approximate search probes by default, in percent.
PROBED = 45
CHUNK_KEYS = ["document_id", "chunk_index"]
SOURCE_FIELDS = ("content", "score", "file_name", "chunk_index", "page_number", "metadata")


def _with_limit(queries: DataFrame, k: int) -> DataFrame:
    """``top_k`` per query: its own where given, else ``k``."""
    own = F.col("top_k") if "top_k" in queries.columns else F.lit(None)
    return queries.withColumn("top_k", F.coalesce(own.cast("int"), F.lit(k)))


def _of_config(chunks: DataFrame, config_hash: str | None) -> DataFrame:
    """Chunks of one config version; on the stored table this prunes folders."""
    return chunks if config_hash is None else chunks.filter(F.col("extraction_config_hash") == config_hash)


def attach_chunks(
    hits: DataFrame, chunks: DataFrame, documents: DataFrame | None, keys: list[str], small: bool
) -> DataFrame:
    """File name, content and metadata for the ranked rows; the wide columns are read only here.

    ``small`` says the number of hits is proven bounded: then they are broadcast, so that neither the documents nor the
    chunk contents are shuffled. Larger results are left to a shuffled join.
    """

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    if documents is not None:
        hits = documents.select(F.col("id").alias("document_id"), "file_name").join(side(hits), "document_id")
    extra = [c for c in ("content", "metadata") if c in chunks.columns]
    out = chunks.select(*keys, *extra).join(side(hits), keys) if extra else hits
    return out.withColumn("page_number", page_number_of(F.col("metadata"))) if "metadata" in extra else out


def search(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame | None = None,
    k: int = CHAT_TOP_K,
    metric: str = "cosine",
    config_hash: str | None = None,
    keys: list[str] = CHUNK_KEYS,
    block_bytes: int = BLOCK_BYTES,
    broadcast_hits: int = MAX_BROADCAST_HITS,
) -> DataFrame:
    """The ``k`` nearest chunks of every query, nearest first, ties by chunk key.

    ``queries``: query_id, embedding and optionally top_k (null means ``k``). ``metric`` is cosine, l2 or inner; the
    score is the similarity, the distance or the product. Chunks are ranked on (key, vector) alone, and only the ranked
    rows are joined to contents and documents. With ``documents``, chunks without their document are left out before the
    ranking, so they take no rank. A query with a ``top_k`` below 1 gives no row. Query vectors go out in blocks of
    ``block_bytes``; results of at most ``broadcast_hits`` rows (sum of all top_k) are broadcast to the contents.
    """
    pool = wide = _of_config(chunks, config_hash)
    if documents is not None:
        pool = pool.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi").select(pool.columns)
    hits, bound = nearest_sized(_with_limit(queries, k), pool, keys, DenseVectors(metric), block_bytes)
    if metric == "l2":
        hits = hits.withColumn("score", -F.col("score"))
    # The hits are of chunks with a document, so the contents need not meet the documents' ids again.
    return attach_chunks(hits, wide, documents, keys, bound <= broadcast_hits)


def sparse_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = CHAT_TOP_K,
    keys: list[str] = CHUNK_KEYS,
    block_bytes: int = BLOCK_BYTES,
    broadcast_hits: int = MAX_BROADCAST_HITS,
) -> DataFrame:
    """Cosine search over sparse integer vectors (``bucket``/``weight`` arrays, see ``embedding.hashed_counts``)."""
    hits, bound = nearest_sized(_with_limit(queries, k), chunks, keys, SparseCounts(), block_bytes)
    return attach_chunks(hits, chunks, None, keys, bound <= broadcast_hits)


def best_match(queries: DataFrame, corpus: DataFrame, key: str = "chunk_index") -> DataFrame:
    """(query_id, key, score) of the single most similar row with a score above 0; the first on ties, null when none."""
    queries = stage(queries.select("query_id", "embedding"), "queries")
    one = nearest(queries.withColumn("top_k", F.lit(1)), corpus, [key]).filter(F.col("score") > 0)
    return queries.select("query_id").join(one.select("query_id", key, "score"), "query_id", "left")


# -- approximate search -----------------------------------------------------------------------------------------------


def pivots(chunks: DataFrame, lists: int, keys: list[str] = CHUNK_KEYS) -> np.ndarray:
    """At most ``lists`` unit vectors: those of the chunks whose keys have the smallest md5, copies once, without zero vectors."""
    place = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    usable = chunks.filter(V.inner_product(F.col("embedding"), F.col("embedding")) > 0)
    rows = usable.select(place.alias("place"), *keys, "embedding").orderBy("place", *keys).limit(lists)
    vectors = [np.asarray(r["embedding"], np.float64) for r in rows.select("embedding").toLocalIterator()]
    if not vectors:
        return np.empty((0, 0))
    units = np.stack([v / np.sqrt((v**2).sum()) for v in vectors])
    return units[np.sort(np.unique(units, axis=0, return_index=True)[1])]


def _products(vectors: pd.Series, centres: np.ndarray) -> Iterator[np.ndarray]:
    """Rounded products of the vectors with all pivots, some rows at a time; undefined ones come last."""
    for low in range(0, len(vectors), 1024):
        products = np.round(np.stack(vectors.iloc[low : low + 1024].to_numpy()).astype(np.float64) @ centres.T, 9)
        yield np.where(np.isnan(products), -np.inf, products)


def _nearest_list(rows: DataFrame, centres: np.ndarray, width: int, carry: list[str]) -> DataFrame:
    """``carry``, the number of the nearest pivot within its bucket of ``width`` (``list_no``) and the bucket; ties go to the smaller number."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(shared.value):
                yield pd.Series(np.zeros(len(vectors), np.int32))
                continue
            yield pd.Series(np.concatenate([p.argmax(1) for p in _products(vectors, shared.value)] or [np.empty(0)]).astype(np.int32))

    held = stage(rows.select(*carry, nearest_list("embedding").alias("at")), "lists")
    return held.select(*carry, F.floor(F.col("at") / width).cast("int").alias("bucket"), (F.col("at") % width).alias("list_no"))


def _probed(products: np.ndarray, probes: int) -> np.ndarray:
    """rows x pivots: the ``probes`` nearest pivots of every row; ties go to the smaller number."""
    probes = min(probes, products.shape[1])
    bar = np.partition(products, -probes, axis=1)[:, -probes, None]
    above, tied = products > bar, products == bar
    return above | (tied & (tied.cumsum(1) <= probes - above.sum(1, keepdims=True)))


def _probed_lists(rows: DataFrame, centres: np.ndarray, width: int, probes: int, carry: list[str]) -> DataFrame:
    """``carry`` of every row once for each bucket of ``width`` lists in which it probes any, with the bitmap of those lists."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<struct<bucket:int,probed:binary>>")
    def bitmaps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(shared.value):
                yield pd.Series([[{"bucket": 0, "probed": np.packbits([True] + [False] * (width - 1)).tobytes()}]] * len(vectors), dtype=object)
                continue
            found = []
            for products in _products(vectors, shared.value):
                wanted = _probed(products, probes)
                wanted = np.pad(wanted, ((0, 0), (0, -wanted.shape[1] % width))).reshape(len(wanted), -1, width)
                packed, used = np.packbits(wanted, axis=2), wanted.any(2)
                found += [[{"bucket": int(b), "probed": packed[i, b].tobytes()} for b in np.flatnonzero(used[i])] for i in range(len(wanted))]
            yield pd.Series(found, dtype=object)

    held = stage(rows.select(*carry, bitmaps("embedding").alias("__buckets")), "lists")
    return held.select(*carry, F.explode("__buckets").alias("__b")).select(*carry, "__b.bucket", "__b.probed")


def approx_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = CHAT_TOP_K,
    lists: int | None = None,
    probes: int | None = None,
    keys: list[str] = CHUNK_KEYS,
) -> DataFrame:
    """Nearest chunks among those in the ``probes`` lists whose pivots are nearest to the query (not exact).

    Every chunk is in one list, that of its nearest pivot, so it is shuffled once. ``lists`` is by default eight times the root
    of the number of chunks, so lists stay about as long as an eighth of that root; ``probes`` is by default 45 % of the lists,
    which finds at least nine in ten of the five nearest even among vectors without any clusters.
    Fixed ``probes`` make the work per query grow with the root only, at the price of recall; measure with
    :func:`recall_against`. Within its candidates the ranking is exact; lists of any size are cut into bounded cells. Zero
    vectors fall into the first list. No chunks give no rows. Only the pivots reach the driver and the workers: 250,000 of
    them for a billion chunks. Neighbouring lists share a bucket of about ``BLOCK_BYTES``, and a query goes to a bucket once,
    with a bitmap of the lists it probes there, so the shuffle grows with the buckets and not with the probed lists.
    """
    count = chunks.count()
    lists = lists or 8 * math.isqrt(max(count - 1, 0)) + 8
    centres = pivots(chunks, lists, keys)
    probes = probes or max(1, len(centres) * PROBED // 100)
    cell = min(CELL_ROWS * 4, max(512, BLOCK_BYTES // (8 * max(1, centres.shape[1]))))
    buckets = max(-(-count // cell), queries.sparkSession.sparkContext.defaultParallelism)
    width = max(1, -(-len(centres) // buckets))
    q = _probed_lists(_with_limit(queries, k), centres, width, probes, ["query_id", "top_k", "embedding"])
    c = _nearest_list(chunks, centres, width, [*keys, "embedding"])
    return bucketed_nearest(q, c, ["bucket"], keys, query_cell=cell, chunk_cell=cell, lists=("probed", "list_no"))


def recall_against(exact: DataFrame, found: DataFrame, keys: list[str] = CHUNK_KEYS) -> DataFrame:
    """(query_id, recall): share of the exact results that were found."""
    hits = found.select("query_id", *keys, F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", *keys], "left").groupBy("query_id").agg(
        (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )


# -- requests and responses -------------------------------------------------------------------------------------------


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a question of at least one character and top_k null or at least 1, and the others with a reason."""
    question = F.col("question")
    reason = first_reason(
        (question.isNull() | (F.length(question) < 1), "question is empty"),
        (F.coalesce(F.col("top_k") < 1, F.lit(False)), "top_k is below 1"),
    )
    return split_on_reason(requests, reason)


def sources_array(order: list[Column]) -> Column:
    """Aggregate: array of source structs of a request in the given order."""
    fields = F.struct(*[F.col(f).alias(f) for f in SOURCE_FIELDS])
    rows = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], fields.alias("source")))
    return F.transform(F.array_sort(rows), lambda r: r["source"])


def accumulate_sources(calls: DataFrame) -> DataFrame:
    """(request_id, sources): results of all searches of a request in call order, then rank; repeats stay."""
    return calls.groupBy("request_id").agg(sources_array([F.col("call_no"), F.col("rank")]).alias("sources"))


def responses(requests: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, answer, sources): every request appears, with an empty list when nothing was retrieved."""
    out = requests.select("request_id").join(answers.select("request_id", "answer"), "request_id", "left")
    out = out.join(sources, "request_id", "left")
    none = F.array().cast(sources.schema["sources"].dataType)
    return out.select("request_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("sources", none).alias("sources"))
