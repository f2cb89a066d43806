"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours; partial sums, so a hub costs little."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to its least one.

    A large star gives a row per link at most, some of them equal; a small star drops those.
    """
    a, b = edges.columns
    if small:
        pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    else:
        pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(
            edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    # u as an expression: the join then deals both sides out itself, and its tasks can be split where a hub has many pairs
    met = pairs.join(_least(pairs).select(F.when(F.col("m") <= F.col("u"), F.col("u")).alias("u"), "m"), "u")
    if not small:
        return met.where("v > u AND v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # each row links its v, and the u of all its rows, to m
    return met.select(F.explode(F.array(*(F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in "uv"))).alias("link")).select(
        "link.*").where("a != b").distinct()


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The saved ``edges``, and their number and the sum of their hashes, which are taken as they are written."""
    seen = Observation()
    marks = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("x"))
    out = saved(edges.observe(seen, *marks), name)
    return out, (seen.get.get("n", 0), seen.get.get("x", 0))  # a plan found empty takes no marks


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two bigint columns); component: its least node.

    Rounds of a large and a small star, each written to the shared folder,
    until the links stay as they are; then every node is linked to the least of
    its component. The rounds grow with the logarithm of the longest chain.
    """
    a, b = links.columns
    edges, seen = _kept(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "links")
    if seen[0]:
        for k in range(64):
            edges, now = _kept(_star(saved(_star(edges, False), f"star-l{k}"), True), f"star-s{k}")
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError("the links did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
