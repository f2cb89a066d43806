"""Chunking and similarity top-k retrieval.

The searches themselves are in ``set_search`` (token sets over an inverted
index) and ``vector_search`` (blocks with centre and radius); both are exact
and leave out what a bound rules out before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_J, bind_column, col, let, strip
from .sampling import ROW, head, in_order, partition_of
from .set_search import top_k_sets
from .vector_search import top_k_vectors

# Retrieval defaults of the reference configuration.
TOP_K = 2
CHUNK_TOKENS = 512
SIMILARITIES = ("cosine", "dot_product", "max_inner_product", "jaccard")

WORD = r"[\p{L}\p{Nd}_]+"             # token of a set-similarity bag (same in Java and RE2)


# --------------------------------------------------------------- J5, J6

def words(text: Column | str) -> Column:
    """Whitespace-separated words (``str.split()``); empty text -> empty array."""
    return let(strip(text), lambda s: F.when(s == "", F.array().cast("array<string>"))
               .otherwise(F.split(s, WS_J + "+")))


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    chunk_tokens: int = CHUNK_TOKENS, max_chunks: int | None = None) -> DataFrame:
    """J5 + J6: consecutive chunks of ``chunk_tokens`` words per document,
    ``(doc_id, chunk_idx, n_words, text)``. All chunks by default (a pure map);
    with ``max_chunks`` only the first ones in (doc_id, chunk_idx) order (see
    ``_first_chunks``; ids must then be unique, a null id comes first).
    """
    docs = docs.select(doc_id, text)
    if max_chunks is None:
        return _chunks(docs, doc_id, text, chunk_tokens)
    return _first_chunks(docs, doc_id, text, chunk_tokens, max_chunks)


def _n_chunks(text: Column | str, chunk_tokens: int) -> Column:
    return F.ceil(F.size(words(text)) / F.lit(chunk_tokens)).cast("int")


def _chunks(docs: DataFrame, doc_id: str, text: str, chunk_tokens: int, keep: Column | None = None) -> DataFrame:
    """Chunks of every document, of each only the first ``keep`` if given."""
    d = bind_column(docs, words(text), "__w")
    n = F.ceil(F.size("__w") / F.lit(chunk_tokens)).cast("int")
    n = n if keep is None else F.least(n, keep)
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(idx, lambda i: F.struct(
        i.alias("chunk_idx"),
        F.slice("__w", i * chunk_tokens + 1, chunk_tokens).alias("__cw")))
    out = d.select(doc_id, F.inline(chunks))
    return out.select(doc_id, "chunk_idx", F.size("__cw").alias("n_words"),
                      F.array_join("__cw", " ").alias("text"))


def _first_chunks(docs: DataFrame, doc_id: str, text: str, chunk_tokens: int, max_chunks: int) -> DataFrame:
    """The chunks before the cut, which is one (document, chunk) pair.

    Only documents up to some id can hold the first ``max_chunks`` chunks. That
    id is found on the id column alone; beginning with as many ids as chunks
    are wanted and widened while empty texts leave too few. Chunk counts of
    these documents are range-partitioned by id, and a two-level prefix sum
    (over partitions, then inside the one that holds the cut) finds the cut.
    To the driver come a count per partition and the row at the cut; the
    chunks are then made in one map behind a filter on the id that Parquet sees.
    """
    ahead, part = max_chunks, partition_of()
    while True:
        near = head(docs, doc_id, ahead)
        counts = in_order(near.select(doc_id, _n_chunks(text, chunk_tokens).cast("bigint").alias("__n")).where("__n > 0"),
                          (), [doc_id], "chunk_counts")
        totals = sorted(map(tuple, counts.groupBy(part.alias("p")).agg(F.sum("__n")).collect()))
        if near is docs or sum(n for _, n in totals) >= max_chunks:
            break
        ahead *= 4
    left = max_chunks
    for p, n in totals:
        if n > left:
            break
        left -= n
    else:  # all chunks of these documents are among the first
        return _chunks(near, doc_id, text, chunk_tokens)
    inside = Window.partitionBy(part).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    row = counts.where(part == p).withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))) \
        .where((F.col("__before") <= left) & (F.col("__before") + F.col("__n") > left)).first()
    at = F.lit(row[doc_id]).cast(docs.schema[doc_id].dataType)
    keep = F.when(F.col(doc_id).eqNullSafe(at), int(left - row["__before"]))  # null, thus all, before the cut
    upto = F.col(doc_id).isNull() if row[doc_id] is None else F.col(doc_id).isNull() | (F.col(doc_id) <= at)
    return _chunks(docs.where(upto), doc_id, text, chunk_tokens, keep)


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), 0))


def token_hashes(text: Column | str) -> Column:
    """64-bit hashes of the distinct tokens (what the similarity kernel compares)."""
    return F.transform(token_set(text), lambda t: F.xxhash64(t))


# ------------------------------------------------------------------ J1, R7

def top_k(queries: DataFrame, corpus: DataFrame, q_id: str, q_value: Column,
          c_ids: list[str], c_value: Column, sim: str = "cosine", k: int = TOP_K,
          exclude_self: bool = False, **options: int) -> DataFrame:
    """J1 + R7: for every query, the ``k`` most similar corpus rows.

    Output ``(query_id, rank, c_ids..., similarity)``; similarity is rounded
    to 6 places before ranking, ties go to the smaller corpus id. Query ids
    must be unique, of any orderable type. Rows without a value have no
    similarity to anything. Sets go to ``set_search``, vectors to ``vector_search`` (which takes ``options``).
    """
    if sim not in SIMILARITIES:
        raise ValueError(f"similarity must be one of {SIMILARITIES}")
    c = corpus.select(*c_ids, c_value.alias("__cv")).where(F.col("__cv").isNotNull())
    q = queries.select(F.col(q_id).alias("query_id"), q_value.alias("__qv")).where(F.col("__qv").isNotNull())
    if sim == "jaccard":
        return top_k_sets(q, c, c_ids, k, exclude_self)
    return top_k_vectors(q, c, c_ids, sim, k, exclude_self, **options)


def retrieve_vectors(queries: DataFrame, corpus: DataFrame, q_id: str = "vec_id",
                     c_id: str = "vec_id", vector: str = "embedding", sim: str = "cosine",
                     k: int = TOP_K, exclude_self: bool = False) -> DataFrame:
    """J1-J3 over vector columns."""
    return top_k(queries, corpus, q_id, F.col(vector), [c_id], F.col(vector), sim, k, exclude_self)


def retrieve_text(queries: DataFrame, corpus: DataFrame, q_id: str, q_text: str,
                  c_ids: list[str], c_text: str, k: int = TOP_K) -> DataFrame:
    """Token-set Jaccard retrieval between two text tables."""
    return top_k(queries, corpus, q_id, token_hashes(q_text), c_ids, token_hashes(c_text), "jaccard", k)
