"""Exact top-k by inner product or cosine, with blocks bounded by centre and radius.

Corpus vectors belong to the nearest of a bounded sample of them, the centres;
the vectors of a centre, cut to a bounded size, are a block with a radius. A
query ``q`` scores at most ``q . centre + |q| * radius`` in a block, so the k-th
best score found in the block that promises most settles which other blocks
a query still has to meet. Only these (query, block) pairs are shuffled; a
corpus row is copied only where more queries meet its block than a task should hold.

Cosine is bounded on unit vectors and scored as the inner product over both norms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.sinks import stored

BLOCK_BYTES = 16 * 1024 * 1024         # of one block of corpus vectors, and of the queries that meet it in one task
CENTRES = 512                          # vectors sampled as centres, at most
PAIR_BLOCK = 1_000_000                 # scored cells per NumPy step (memory bound per task)
QUERY_STEP = 256                       # queries of one such step
DIRECT_CELLS = 1 << 26                 # up to so many pairs, bounds cost more than they save: every block is met at once
ROUND = 6                              # similarities are rounded before ranking


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _same(x: np.ndarray) -> np.ndarray:
    return x


def scores(qv: np.ndarray, cv: np.ndarray, sim: str) -> np.ndarray:
    if sim != "cosine":
        return qv @ cv.T          # dot_product / max_inner_product rank identically
    with np.errstate(divide="ignore", invalid="ignore"):
        return (qv @ cv.T) / np.outer(np.linalg.norm(qv, axis=1), np.linalg.norm(cv, axis=1))


def bounds(qv: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block, with room for rounding."""
    reach = qv @ centres.T + np.linalg.norm(qv, axis=1)[:, None] * radius[None, :]
    return reach + 2 * 10.0 ** -ROUND + 1e-9 * np.abs(reach)


def _best(queries: pd.DataFrame, corpus: pd.DataFrame, sim: str, k: int, c_ids: list[str], exclude_self: bool) -> pd.DataFrame | None:
    """The k best rows of a block for each of its queries, ties to the smaller ids.

    The corpus is scored in order of its ids, so once a query has k rows, only a higher
    score than the k-th replaces one: cells below it are passed over, and ties pile up nowhere.
    """
    corpus = corpus.sort_values(c_ids, kind="mergesort")
    q_ids, own, cv = queries["query_id"].to_numpy(), corpus[c_ids[0]].to_numpy(), _matrix(corpus["__cv"])
    rows, at_once, parts = queries["__qv"].to_numpy(), min(len(queries), QUERY_STEP), []
    step = max(1, PAIR_BLOCK // at_once)
    for start in range(0, len(queries), at_once):
        ids, qv = q_ids[start:start + at_once], _matrix(rows[start:start + at_once])
        kth = np.full(len(ids), -np.inf)
        q, c, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(cv), step):
            s = scores(qv, cv[at:at + step], sim)
            if len(s[0]) > k and not np.isfinite(kth).any():  # nothing to hold against yet: the k best of this step
                s = np.where(np.isfinite(s), np.round(s, ROUND), -np.inf)
                if exclude_self:
                    s[ids[:, None] == own[None, at:at + step]] = -np.inf
                low = np.partition(s, len(s[0]) - k, axis=1)[:, len(s[0]) - k]
            else:
                with np.errstate(invalid="ignore"):
                    low = np.where(np.isfinite(kth), kth - 10.0 ** -ROUND - 1e-12 * np.abs(kth), -np.inf)
            qi, cj = np.nonzero(s >= low[:, None])
            v = np.round(s[qi, cj], ROUND)
            new = np.isfinite(v) & (v > kth[qi])
            if exclude_self:
                new &= ids[qi] != own[at + cj]
            if not new.any():
                continue
            q, c, best = np.concatenate([q, qi[new]]), np.concatenate([c, at + cj[new]]), np.concatenate([best, v[new]])
            order = np.lexsort((c, -best, q))
            q, c, best = q[order], c[order], best[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, c, best, place = q[place < k], c[place < k], best[place < k], place[place < k]
            kth[q[place == k - 1]] = best[place == k - 1]
        parts.append((ids[q], c, best))
    found = [np.concatenate(x) for x in zip(*parts)]
    if not len(found[0]):
        return None
    return pd.DataFrame({"query_id": found[0]} | {c: corpus[c].to_numpy()[found[1]] for c in c_ids} | {"similarity": found[2]})


class VectorIndex:
    """Corpus vectors in blocks around centres; ``block`` = centre * 2^32 + slice."""

    def __init__(self, corpus: DataFrame, c_ids: list[str], sim: str, centres: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
        self.c_ids, self.sim, self.block_bytes = c_ids, sim, block_bytes
        self.bound = _unit if sim == "cosine" else _same  # the vectors that bounds are made of
        ship_package(corpus.sparkSession)
        self.slots = corpus.sparkSession.sparkContext.defaultParallelism
        rows, elements = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__cv")), F.lit(0))).first()
        self.rows, self.row_bytes = rows, 8 * (1 + elements / max(rows, 1))
        wanted = centres or min(CENTRES, max(self.slots, math.ceil(rows * self.row_bytes / block_bytes), math.isqrt(rows) // 4))
        sample = corpus.select("__cv").orderBy(F.xxhash64(*c_ids), *c_ids).limit(wanted).collect()
        self.centres = self.bound(_matrix([r[0] for r in sample])) if sample else np.zeros((0, 0))
        self.blocks = stored(self._dealt(corpus), "blocks")
        self.table = self.blocks.groupBy("block").agg(F.max("distance").alias("radius")).orderBy("block").collect() if len(self.centres) else []
        self.block_ids = np.array([r["block"] for r in self.table], np.int64)
        self.radius = np.array([r["radius"] for r in self.table])

    def _dealt(self, corpus: DataFrame) -> DataFrame:
        """``corpus`` with block and distance from the centre; a centre with many vectors has several slices."""
        centres, bound = self.centres, self.bound
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = bound(_matrix(frame["__cv"]))
                    at = np.argmin((centres ** 2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
                    yield frame.assign(centre=at.astype(np.int64), distance=np.linalg.norm(x - centres[at], axis=1))

        if not len(centres):
            return corpus.withColumn("block", F.lit(0).cast("long")).withColumn("distance", F.lit(0.0))
        held = stored(corpus.mapInPandas(near, f"{kinds}, centre bigint, distance double"), "near")
        each = max(1, int(self.block_bytes / self.row_bytes))
        slices = {r["centre"]: math.ceil(r["n"] / each) for r in held.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
        many = [F.when(F.col("centre") == c, F.lit(n)) for c, n in slices.items() if n > 1]  # at most CENTRES
        part = F.pmod(F.xxhash64(*self.c_ids), F.coalesce(*many, F.lit(1))) if many else F.lit(0)
        return held.withColumn("block", F.shiftleft("centre", 32) + part).drop("centre")

    def _placed(self, queries: DataFrame, first: bool) -> DataFrame:
        """One row per query that has blocks to be met: (query_id, __qv, blocks); a vector is not copied in Python.

        ``first``: the block that promises most; else the others that reach the query's ``floor`` (null: all).
        """
        ids, radius, bound = self.block_ids, self.radius, self.bound
        of_block = self.centres[(ids >> 32).astype(int)] if len(ids) else self.centres
        kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), max(1, PAIR_BLOCK // max(len(ids), 1))):
                    part = frame.iloc[at:at + max(1, PAIR_BLOCK // max(len(ids), 1))]
                    if not len(ids):
                        continue
                    reach = bounds(bound(_matrix(part["__qv"])), of_block, radius)
                    most = reach.argmax(axis=1)
                    met = np.full(reach.shape, not first)
                    met[np.arange(len(part)), most] = first
                    if not first:
                        met &= ~(reach < part["floor"].to_numpy(np.float64, na_value=-np.inf)[:, None])
                    some = met.any(axis=1)
                    if some.any():
                        yield part.loc[some, ["query_id", "__qv"]].assign(blocks=[ids[m] for m in met[some]])

        return queries.mapInPandas(place, f"query_id {kinds['query_id']}, __qv array<double>, blocks array<bigint>")

    def meet(self, placed: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """The k best of each (query, block) pair: (query_id, corpus ids, similarity)."""
        placed = pairs(placed)
        each = max(1, int(self.block_bytes / self.row_bytes))
        tasks = max(1, self.slots // max(len(self.block_ids), 1))  # small inputs use all cores too
        parts = placed.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(each)), F.lit(tasks)).cast("int").alias("parts"))
        parts = F.broadcast(stored(parts, "parts"))  # a row per block, as the driver's block table
        left = placed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
        right = self.blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "distance")
        return _met(left, right, ["block", "part"], self.c_ids, self.sim, k, exclude_self)


def _met(queries: DataFrame, corpus: DataFrame, keys: list[str], c_ids: list[str], sim: str, k: int, exclude_self: bool) -> DataFrame:
    """The k best of each query in each group of ``keys``, scored where both sides of the group come together."""
    kinds = {f.name: f.dataType.simpleString() for f in [*corpus.schema, *queries.schema]}
    names = ["query_id", *c_ids, "similarity"]
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names[:-1]), "similarity double"])

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = _best(q, c, sim, k, c_ids, exclude_self) if len(q) and len(c) else None
        return pd.DataFrame(columns=names) if found is None else found

    return queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInPandas(best, schema)


def _finite(df: DataFrame, value: str, sim: str) -> DataFrame:
    """Rows whose vector can score: not null, finite, for cosine not zero."""
    v = F.col(value).cast("array<double>")
    df = df.withColumn(value, v).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    return df.where(F.exists(value, lambda x: x != 0)) if sim == "cosine" else df


def top_k_vectors(queries: DataFrame, corpus: DataFrame, c_ids: list[str], sim: str, k: int, exclude_self: bool = False,
                  centres: int | None = None, block_bytes: int = BLOCK_BYTES, direct_cells: int = DIRECT_CELLS) -> DataFrame:
    """(query_id, rank, corpus ids, similarity) of the ``k`` best corpus vectors of every query.

    ``queries`` has (query_id, __qv), ``corpus`` (ids, __cv); ids are unique. Similarities
    are rounded to 6 places before ranking, ties go to the smaller corpus id.
    Vectors that are null, not finite, or for cosine zero, score nothing.
    """
    q = _finite(queries.select("query_id", "__qv"), "__qv", sim)
    c = _finite(corpus.select(*c_ids, "__cv"), "__cv", sim)
    if q.count() * c.count() <= direct_cells:
        ship_package(corpus.sparkSession)
        slots = corpus.sparkSession.sparkContext.defaultParallelism
        found = _met(q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))),
                     c.withColumn("block", F.pmod(F.xxhash64(*c_ids), F.lit(slots)).cast("int")), ["block"], c_ids, sim, k, exclude_self)
    else:
        found = pruned(VectorIndex(c, c_ids, sim, centres, block_bytes), q, k, exclude_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *c_ids)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", *c_ids, "similarity")


def pruned(index: VectorIndex, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Candidates of every query from the block that promises most, and from those whose bound reaches the k-th best there.

    What is stored has a query once, with its blocks; pairs are only made where they are shuffled.
    """
    first = stored(index.meet(stored(index._placed(queries, True), "first"), k, exclude_self), "found")
    return first.unionByName(index.meet(stored(_left(index, queries, first, k), "rest"), k, exclude_self))


def pairs(placed: DataFrame) -> DataFrame:
    """A row per query and block."""
    return placed.select("query_id", "__qv", F.explode("blocks").alias("block"))


def rest(index: VectorIndex, queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The (query, block) pairs that are left after the first block."""
    return pairs(_left(index, queries, first, k))


def _left(index: VectorIndex, queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    floors = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"))))
    floors = floors.where(F.col("n") == k).select("query_id", F.col("similarity").alias("floor"))
    return index._placed(queries.join(floors, "query_id", "left"), False)
