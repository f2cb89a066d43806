"""Whitening of embeddings by a covariance weighted with multiplicities.

Every component becomes a whole number, and equal vectors become one row with
its number of occurrences. The fit runs over these distinct vectors, each with
its count as weight (or with one): exact sums per dimension, then a centred
matrix product per partition, ``(w * z).T @ z``, whose upper triangles are added
up by Spark. Only the triangle comes to the driver, which takes its eigenvectors;
its size is set by the dimension, not by the rows. Each distinct vector is
centred, projected and scaled once and joined back to the rows that hold it.

The matrix product is centred at the whole number nearest the mean, so that its
terms are whole and its sums exact as long as they stay below 2^53; the rest to
the mean, at most a half, is taken off afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import met_by_key, saved

#: What turns a component into a whole number.
SCALE = 1024
SHIFT = 100_000
#: Components that are returned at most.
COMPONENTS = 8
#: An eigenvalue below this share of the largest, times the dimension, is no variance but rounding.
RANK_EPS = 2.0 ** -50
#: Whole vectors are kept within this bound, so that sums over 2^11 dimensions cannot pass 64 bits unseen.
LIMIT = float(1 << 52)
#: Vectors that one step of a matrix product takes.
STEP = 8192


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and ``x`` (array<bigint>) of the rows that take part."""
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LIMIT))
    sized = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    return sized.select("vec_id", F.transform("v", lambda c: (F.floor(c * SCALE) + F.lit(SHIFT)).cast("bigint")).alias("x"))


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    """The equally long lists of an Arrow column as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _sums(distinct: DataFrame) -> list[int]:
    """The exact weighted sum of each dimension: whole numbers in every partition, decimals between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x, w = _matrix(part.column(0), np.int64), part.column(1).to_numpy()
                small = (int(np.abs(x).max()) + 1) * int(w.sum()) < 1 << 62
                add = (w @ x if small else w.astype(object) @ x.astype(object)).tolist()
                total = add if total is None else [a + b for a, b in zip(total, add)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(str, total), pa.string())], names=["i", "s"])

    sums = distinct.select("x", "w").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [int(s) for _, s in sorted(map(tuple, sums.collect()))]


def _triangle(vectors: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """The weighted sum of (z, 1) (z, 1)' over ``vectors`` (``column``, w), z being the vector less ``centre``.

    Each partition multiplies its own vectors and hands on one triangle, whose
    entries Spark adds up by their place.
    """
    d = len(centre) + 1
    upper = np.triu_indices(d)
    whole = vectors.schema[column].dataType.elementType.typeName() == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                z = _matrix(part.column(0), np.int64 if whole else np.float64) - centre
                z = np.column_stack([z.astype(np.float64), np.ones(len(z))])
                total += (part.column(1).to_numpy().astype(np.float64)[:, None] * z).T @ z
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], names=["at", "v"])

    sums = vectors.select(column, "w").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for at, v in sums:
        i, j = upper[0][at], upper[1][at]
        out[i, j] = out[j, i] = v
    return out


def _covariance(vectors: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """Covariance of the weighted vectors, divisor their weight."""
    moments = _triangle(vectors, column, centre)
    weight, rest = moments[-1, -1], moments[-1, :-1]
    return moments[:-1, :-1] / weight - np.outer(rest, rest) / weight ** 2


def principal_axes(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns; those without variance have the eigenvalue 0."""
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    return np.where(e > RANK_EPS * len(cov) * max(e[0], 0.0), e, 0.0), vectors


def _whitened(distinct: DataFrame, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray) -> DataFrame:
    """``distinct`` (x, w) plus deviation and the projections ``z`` (0 along an axis without variance) of each vector."""
    total = np.array(sums, object)
    base = total // n  # exact Python integers
    rest = total - base * n  # 0 .. n - 1
    centre, remainder = base.astype(np.int64), rest.astype(np.float64) / n
    scale = np.divide(1.0, np.sqrt(values), out=np.zeros(len(values)), where=values > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _matrix(part.column(0), np.int64) - centre
                z = ((x - remainder) @ axes) * scale
                reach = (int(np.abs(x).max()) + 1) * n
                if reach * reach * x.shape[1] < 1 << 63:
                    off = n * x - rest.astype(np.int64)
                    deviation = (off * off).sum(axis=1).tolist()
                else:
                    off = n * x.astype(object) - rest
                    deviation = (off * off).sum(axis=1).tolist()
                digits = pa.array([str(v) for v in deviation], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digits, lists], names=["x", "w", "deviation", "z"])

    return distinct.mapInArrow(run, "x array<bigint>, w bigint, deviation string, z array<double>")


EMPTY = "vec_id bigint, component int, n bigint, deviation string, whitened double, explained double, identity_error double, occurrences bigint"


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, occurrences.

    ``weights="counts"`` fits over all rows, ``"one"`` over the distinct
    vectors; ``n`` and ``deviation`` belong to the list that is fitted.
    ``deviation`` is exact, as decimal digits: it passes 64 bits on large tables.
    Rows whose vector is null, empty, holds null or non-finite entries, or
    entries of 2^42 and more, take no part; nor do vectors shorter or
    longer than most (of equally frequent lengths the longer counts). Rows
    without vec_id and repeated rows take part and get their own rows. Along an axis
    without variance (fewer vectors than dimensions, constant tables) whitened
    is null, explained 0, and identity_error leaves it out. Of equal
    eigenvalues any order holds. No remaining row: no rows. Other columns are not looked at.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    spark = rows.sparkSession
    ship_package(spark)
    every = saved(whole_vectors(rows), "vectors")
    sizes = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], EMPTY)
    held = every.where(F.size("x") == sizes["d"])
    fitted = saved(held.groupBy("x").agg(F.count("*").alias("occurrences"))
                   .withColumn("w", F.col("occurrences") if weights == "counts" else F.lit(1).cast("bigint")), "distinct")
    distinct = fitted.select("x", "w")
    n = int(distinct.agg(F.sum("w")).first()[0])
    total = _sums(distinct)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)  # the whole number nearest the mean
    cov = _covariance(distinct, "x", centre)
    values, axes = principal_axes(cov, components)
    white = saved(_whitened(distinct, n, total, axes, values), "whitened")
    spread = np.flatnonzero(values > 0)
    error = None
    if len(spread):
        got = _covariance(white, "z", np.zeros(len(values)))[np.ix_(spread, spread)]
        error = float(np.abs(got - np.eye(len(spread))).max())
    trace = float(np.trace(cov))
    share = [float(v) / trace if trace > 0 else 0.0 for v in values]
    named = F.struct(*(F.struct(F.lit(k + 1).cast("int").alias("component"),
                                (F.element_at("z", k + 1) if values[k] > 0 else F.lit(None).cast("double")).alias("whitened"),
                                F.lit(share[k]).alias("explained")).alias(f"c{k}") for k in range(len(values))))
    facts = white.select("x", "deviation", "z").join(fitted.select("x", "occurrences"), "x")
    return met_by_key(held, facts, "x", "occurrences").select(
        "vec_id", F.explode(F.array(*(named[f"c{k}"] for k in range(len(values))))).alias("c"), "deviation", "occurrences").select(
        "vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"), "occurrences")
