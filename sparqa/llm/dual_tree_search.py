"""Exact top-k inner-product search with two cover trees.

Rows are dealt to bounded blocks near common centres, queries to bounded
chunks; every chunk meets every block once. In a task both sides are put in
cover trees: a node's points lie within its radius of its centre, children have
radii smaller by ``BASE`` and centres farther apart than that. A pair of nodes
with centres a, b, radii r, s and norms can reach at most
``a.b + r|b| + s|a| + rs``; it is left out if that is below the worst kth score
of the query node. Each task yields k rows per query, and the k best of those
are the answer.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import arrow_map, saved

#: Bits of each of the three parts that a score is ranked by.
LIMB = 60
#: Neighbours, scale of the components, and the divisor of a query's vec_id.
K = 5
SCALE = 256
EVERY = 50
#: Rows of a block, queries of a chunk, centres, and rows looked at to choose them.
BLOCK_ROWS = 4096
CHUNK_QUERIES = 1024
CENTRES = 16
CENTRE_SAMPLE = 2000
#: Ratio of the radii of two levels, and points of a leaf.
BASE = 1.3
LEAF = 64


class Node:
    """Points ``rows`` within ``radius`` of ``centre``."""

    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, rows: np.ndarray, centre: np.ndarray, radius: float) -> None:
        self.rows, self.centre, self.radius = rows, centre, radius
        self.norm = math.sqrt(float(centre @ centre))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray) -> Node:
    """The tree of the points (float rows, at least one). Small children of a node share a leaf."""
    def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))

    every = np.arange(len(points))
    root = Node(every, points[0], float(distances(every, points[0]).max()))
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= LEAF or node.radius == 0:
            continue
        reach, left, centre = node.radius / BASE, node.rows, node.centre
        few: list[np.ndarray] = []
        while len(left):
            far = distances(left, centre)
            near = far <= reach
            if near.any():
                rows = left[near]
                if len(rows) <= LEAF // 4:
                    few.append(rows)
                else:
                    node.children.append(Node(rows, centre, float(far[near].max())))
            left = left[~near]
            if len(left):
                centre = points[left[0]]
        if few:
            rows = np.concatenate(few)
            for at in range(0, len(rows), LEAF):
                part = rows[at:at + LEAF]
                middle = points[part].mean(axis=0)
                node.children.append(Node(part, middle, float(distances(part, middle).max())))
        todo += [c for c in node.children if len(c.rows) < len(node.rows)]
    return root


def dual_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K) -> list[list[tuple[int, int]]]:
    """The k best (score, vec_id) of each query among the rows with another id; ties to the smaller id."""
    best: list[list[tuple[int, int]]] = [[] for _ in queries]
    worst = np.full(len(queries), -np.inf)
    exact = _exact(queries, rows)
    qf, rf = queries.astype(np.float64), rows.astype(np.float64)

    def bound(q: Node, r: Node) -> float:
        top = float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return top + 1e-9 * (abs(top) + (q.norm + q.radius) * (r.norm + r.radius) + 1)

    def meet(q: Node, r: Node) -> None:
        scores = exact(q.rows, r.rows)
        ids = row_ids[r.rows]
        hit = scores >= worst[q.rows][:, None]
        for a in np.flatnonzero(hit.any(axis=1)).tolist():
            i = int(q.rows[a])
            found = [(int(scores[a, b]), int(ids[b])) for b in np.flatnonzero(hit[a] & (ids != query_ids[i])).tolist()]
            best[i] = heapq.nsmallest(k, best[i] + found, key=lambda x: (-x[0], x[1]))
            if len(best[i]) == k:
                worst[i] = np.nextafter(float(best[i][-1][0]), -np.inf)  # a score past 2^53 may be rounded up

    a, b = cover_tree(qf), cover_tree(rf)
    count = 0
    heap = [(-bound(a, b), 0, a, b)]
    while heap:
        top, _, q, r = heapq.heappop(heap)
        if -top < worst[q.rows].min():
            continue
        if not q.children and not r.children:
            meet(q, r)
            continue
        split_q = q.children and (not r.children or q.radius >= r.radius)
        for x, y in ([(c, r) for c in q.children] if split_q else [(q, c) for c in r.children]):
            limit = bound(x, y)
            if limit >= worst[x.rows].min():
                count += 1
                heapq.heappush(heap, (-limit, count, x, y))
    return best


def _exact(queries: np.ndarray, rows: np.ndarray):
    """Integer products of some queries and rows: in floats below 2^53, else in 64-bit or Python integers."""
    most = lambda x: int(np.abs(x.astype(object)).max()) if x.size else 0
    size = queries.shape[1] * most(queries) * most(rows)
    kind = np.float64 if size < 1 << 53 else np.int64 if size < 1 << 62 else object
    q, r = queries.astype(kind), rows.astype(kind)
    return lambda a, b: q[a] @ r[b].T


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def scaled(table: DataFrame) -> DataFrame:
    """(vec_id, q): distinct rows with a vec_id whose components are all finite; q is floor(SCALE * x).

    A component whose scaled value is beyond 64 bits counts as not finite.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(SCALE * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < float(1 << 54)))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))) \
        .select("vec_id", F.transform(whole, lambda x: x.cast("bigint")).alias("q")).distinct()


def _centres(rows: DataFrame) -> np.ndarray:
    """Centres far from each other in a bounded sample (the rows with the least hash of the id)."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_SAMPLE).collect()
    width = max((len(r["q"]) for r in sample), default=0)
    points = _matrix([r["q"] for r in sample], width).astype(np.float64)
    if not len(points):
        return points
    picked = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < min(CENTRES, len(points)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def top_k(table: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row whose vec_id ``every`` divides.

    Rows with a null vec_id, vector or component, or one that isn't finite,
    take no part; shorter vectors count as ending in zeros. Equal rows count
    once; of equal scores the smaller vec_id comes first. Different vectors
    with one vec_id share its ranking. A score past 64 bits is null, its rank
    exact. A query with fewer than k other rows gets them all. An empty table
    gives no rows. Columns other than vec_id and embedding are not looked at.
    """
    ship_package(table.sparkSession)
    rows = saved(scaled(table.select("vec_id", "embedding")), "scaled")
    centres = _centres(rows)

    def assign(ids: list, vectors: list) -> dict:
        points = _matrix(vectors, max(map(len, vectors))).astype(np.float64)
        width = min(points.shape[1], centres.shape[1])
        far = (centres ** 2).sum(axis=1)[None, :] - 2 * points[:, :width] @ centres[:, :width].T
        return {"centre": far.argmin(axis=1).astype(np.int32) if len(centres) else [0] * len(ids)}

    near = saved(arrow_map(rows, assign, "centre int", ["vec_id", "q"], ["vec_id", "q"]), "assigned")
    counts = {r["centre"]: r["count"] for r in near.groupBy("centre").count().collect()}
    first, blocks = {}, 0
    for c in sorted(counts):
        first[c] = (blocks, math.ceil(counts[c] / block_rows))
        blocks += first[c][1]
    if not blocks:
        return near.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    lookup = lambda at: F.element_at(F.create_map(*(F.lit(x) for c, v in first.items() for x in (c, v[at]))), F.col("centre"))
    block = lookup(0) + F.pmod(F.xxhash64("vec_id", "q"), lookup(1)).cast("int")
    asked = near.where(F.col("vec_id") % every == 0)
    chunks = max(1, math.ceil(asked.count() / chunk_queries))
    left = near.select("vec_id", "q", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = asked.select("vec_id", "q", F.pmod(F.xxhash64("vec_id", "q"), F.lit(chunks)).cast("int").alias("chunk"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(refs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(refs) and len(queries):
            width = max(map(len, [*refs["q"], *queries["q"]]))
            ids = queries["vec_id"].to_numpy(np.int64)
            found = dual_search(_matrix(list(queries["q"]), width), ids, _matrix(list(refs["q"]), width), refs["vec_id"].to_numpy(np.int64), k)
            out = [(int(q), v, *(s >> b if b == 2 * LIMB else s >> b & (1 << LIMB) - 1 for b in (2 * LIMB, LIMB, 0)), s if abs(s) < 1 << 63 else None)
                   for q, best in zip(ids, found) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "high", "middle", "low", "score"]).astype("Int64")

    part = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(
        search, "query_id bigint, vec_id bigint, high bigint, middle bigint, low bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
