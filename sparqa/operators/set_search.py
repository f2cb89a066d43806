"""Exact top-k by Jaccard similarity over token sets, with an inverted index and bounds.

Tokens have one global order, rarest in the corpus first. In it, two sets whose
first common token has ``a`` and ``b`` tokens behind it share at most
``1 + min(a, b)`` tokens, which bounds their similarity. The search widens in two steps:

1. Seeds. Each query meets bounded heads of the posting lists of its rarest
   tokens; the k-th best similarity found there is a floor for its result.
2. All postings whose bound reaches that floor. A query's common tokens, and
   sets of an unfitting size, fall away in the join itself. What is
   left is compared in full. Nothing below the floor can be among the k best.

A query with fewer than k seeds has the floor zero, meets everything that it
shares a token with, and is filled up with the first corpus rows of similarity 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored

#: Rarest tokens of a query whose posting heads give seeds, and sets in such a head.
SEED_TOKENS = 8
HEAD = 64
#: Rows of a two- or three-column side that a join may send to all tasks (16 MiB and less); more are shuffled.
NEAR_ROWS = 1 << 19
ROUND = 6  # similarities are rounded before ranking


def _near(df: DataFrame) -> DataFrame:
    """``df`` as the broadcast side of a join, if its counted rows are few."""
    return F.broadcast(df) if df.count() <= NEAR_ROWS else df


class SetIndex:
    """Postings (token, c, nc, left) of a corpus over the tokens that the queries have.

    ``left`` counts the set's tokens behind the posting's in the global order;
    tokens that no query has come before all others and need no posting.
    """

    def __init__(self, queries: DataFrame, corpus: DataFrame, c_ids: list[str]) -> None:
        sized = lambda df, v, n: df.withColumn(v, F.array_distinct(v)).withColumn(n, F.size(v))
        self.c_ids = c_ids
        self.sets = stored(sized(corpus.select(*c_ids, "__cv"), "__cv", "nc").withColumn("c", F.monotonically_increasing_id()), "sets")
        self.queries = stored(sized(queries.select("query_id", "__qv"), "__qv", "nq"), "queries")
        words = stored(self.queries.select(F.explode("__qv").alias("token")).distinct(), "words")
        flat = self.sets.select("c", "nc", F.explode("__cv").alias("token")).join(_near(words), "token", "left_semi")
        self.counts = stored(flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "counts")
        near = _near(self.counts)
        behind = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("df"), F.desc("token"))) - 1
        self.postings = stored(flat.join(near, "token").select("token", "c", "nc", behind("c").alias("left")), "postings")
        asked = self.queries.select("query_id", "nq", F.explode("__qv").alias("token")).join(near, "token")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token"))
        self.asked = stored(asked.select("token", "query_id", "nq", behind("query_id").alias("q_left"), rank.alias("rank")), "asked")

    def seeds(self) -> DataFrame:
        """Distinct pairs (query_id, c) from the heads of the rarest tokens' posting lists."""
        rare = self.asked.where(F.col("rank") <= SEED_TOKENS)
        head = Window.partitionBy("token").orderBy(F.xxhash64("c"), "c")
        heads = self.postings.join(_near(rare.select("token").distinct()), "token", "left_semi").withColumn(
            "n", F.row_number().over(head)).where(F.col("n") <= HEAD)
        return rare.join(heads, "token").select("query_id", "c").distinct()

    def candidates(self, floors: DataFrame) -> DataFrame:
        """Distinct pairs (query_id, c) that may reach the ``floor`` of their query."""
        floor = F.coalesce(F.col("floor"), F.lit(0.0)) - 10.0 ** -ROUND  # similarities are rounded
        asked = self.asked.join(floors, "query_id", "left").withColumn("floor", floor).where((F.col("q_left") + 1) / F.col("nq") >= F.col("floor"))
        asked = stored(asked.select("token", "query_id", "nq", "q_left", "floor"), "asked-on")
        least = asked.agg(F.coalesce(F.min("floor"), F.lit(0.0))).first()[0]
        most = F.least("q_left", "left") + 1
        reach = most / (F.col("nq") + F.col("nc") - most) >= F.col("floor")
        postings = self.postings.where((F.col("left") + 1) / F.col("nc") >= F.lit(least))
        return postings.join(_near(asked), "token").where(reach).select("query_id", "c").distinct()

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(query_id, c, corpus ids, similarity) of pairs, by their full sets."""
        shared = F.size(F.array_intersect("__qv", "__cv"))
        both = pairs.join(self.queries, "query_id").join(self.sets, "c")
        return both.select("query_id", "c", *self.c_ids, shared.alias("__n"), "nq", "nc").select(
            "query_id", "c", *self.c_ids, F.round(F.col("__n") / (F.col("nq") + F.col("nc") - F.col("__n")), ROUND).alias("similarity"))


def top_k_sets(queries: DataFrame, corpus: DataFrame, c_ids: list[str], k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, corpus ids, similarity) of the ``k`` most similar corpus sets of every query.

    ``queries`` has (query_id, __qv), ``corpus`` (ids, __cv), arrays of bigint;
    ids are unique. Ties go to the smaller corpus id; 0 is a legal similarity, so every query gets k rows if the corpus has them.
    """
    index = SetIndex(queries, corpus, c_ids)
    other = (lambda df: df.where(F.col("query_id") != F.col(c_ids[0]))) if exclude_self else (lambda df: df)
    seeds = stored(other(index.compared(index.seeds())), "seeds")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    floors = seeds.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("similarity").alias("floor"))
    more = index.candidates(floors).join(seeds.select("query_id", "c"), ["query_id", "c"], "left_anti")
    found = stored(seeds.unionByName(other(index.compared(more))).drop("c"), "found")
    every = found.unionByName(other(_zeros(index, found, k)))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *c_ids)
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", *c_ids, "similarity")


def _zeros(index: SetIndex, found: DataFrame, k: int) -> DataFrame:
    """For queries with fewer than k results the first corpus rows that they share nothing with."""
    short = index.queries.select("query_id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = short.where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    first = index.sets.select(*index.c_ids).orderBy(*index.c_ids).limit(2 * k + 1).collect()  # as many rows as k asks for
    kinds = {f.name: f.dataType for f in index.sets.schema.fields}
    row = lambda r: F.struct(*(_lit(r[c], kinds[c]).alias(c) for c in index.c_ids))
    if not first:
        return found.where(F.lit(False))
    zeros = short.select("query_id", F.inline(F.array(*map(row, first)))).withColumn("similarity", F.lit(0.0))
    return zeros.join(found.select("query_id", *index.c_ids), ["query_id", *index.c_ids], "left_anti")


def _lit(value: object, kind) -> Column:
    return F.lit(value).cast(kind)
