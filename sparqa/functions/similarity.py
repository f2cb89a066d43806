"""Similarity of two columns in the same row (J2-J4), JVM-side.

For scoring pairs that already exist (for example re-ranking a candidate
list). Top-k retrieval over whole tables does not build pairs; it uses
``sparqa.operators.retrieval``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product (``dot_product`` / ``max_inner_product`` rank alike)."""
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity (null when either vector has zero length)."""
    def norm(v: Column) -> Column:
        return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return let(F.struct(dot(a, b).alias("d"), norm(col(a)).alias("na"), norm(col(b)).alias("nb")),
               lambda s: F.when((s["na"] > 0) & (s["nb"] > 0), s["d"] / (s["na"] * s["nb"])))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|A n B| / |A u B| of two token arrays (as sets); 0 for two empty sets."""
    inter = F.size(F.array_intersect(col(a), col(b)))
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)
