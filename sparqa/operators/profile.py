"""Length statistics and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_profile(df: DataFrame, text: str = "text", by: str | None = "source",
                   exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Lower median, 90th percentile (linear, truncated) and maximum of
    the character length, per group and overall (group null = all rows).

    Exact percentiles keep one counter per distinct length (partial
    aggregation merges them map-side), which stays small because lengths are
    integers in a bounded range. ``exact=False`` uses ``percentile_approx``
    (fixed-size sketches) for very wide length ranges.
    """
    n = F.col("__n")
    df = df.select(*([] if by is None else [by]), F.length(text).alias("__n"))  # the rollup carries no texts
    if exact:
        median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __n)")
        p90 = F.percentile(n, F.lit(0.9))
    else:
        median = F.percentile_approx(n, 0.5, accuracy)
        p90 = F.percentile_approx(n, 0.9, accuracy)
    aggs = [F.count(F.lit(1)).alias("rows"),
            median.cast("int").alias("median_len"),
            p90.cast("int").alias("p90_len"),
            F.max(n).cast("int").alias("max_len")]
    if by is None:
        return df.agg(*aggs)
    return df.rollup(by).agg(*aggs)


# ------------------------------------------------------- mergeable state

# Lengths below are counted exactly, longer ones by their first bits: relative error below 2 / EXACT_BELOW.
EXACT_BELOW = 256


def length_bucket(n: Column) -> Column:
    """The least length of the bucket of ``n``: ``n`` itself below ``EXACT_BELOW``, then its first 8 bits."""
    bits = F.length(F.bin(n)) - (EXACT_BELOW.bit_length() - 1)
    return F.when(n < EXACT_BELOW, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits)).cast("int")


def length_state(df: DataFrame, text: str = "text", by: tuple[str, ...] = ("source", "split")) -> DataFrame:
    """A4-A6 as a state that can be stored and merged: ``(by..., bucket, rows, max_len)``.

    At most a few thousand rows a group, whatever the number of texts. A null
    text has no length and stands in no bucket: its row has a null bucket.
    """
    d = df.select(*by, F.length(text).alias("__n"))
    return d.groupBy(*by, length_bucket(F.col("__n")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("__n").cast("int").alias("max_len"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several, of the same columns: counts add up, maxima stay."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    by = [c for c in every.columns if c not in ("rows", "max_len")]
    return every.groupBy(*by).agg(F.sum("rows").alias("rows"), F.max("max_len").alias("max_len"))


def profile_of_state(state: DataFrame, *by: str) -> DataFrame:
    """The profile of ``length_profile`` per group from a state: rows and maximum exact, the
    percentiles those of the bucketed lengths, so at most one part in 128 below the exact ones.

    The buckets of a group are few, so they are ranked by one window per group.
    """
    merged = state.groupBy(*by, "bucket").agg(F.sum("rows").alias("rows"), F.max("max_len").alias("max_len"))
    groups = Window.partitionBy(*(F.col(c) for c in by) if by else (F.lit(0),))
    real = F.when(F.col("bucket").isNotNull(), F.col("rows")).otherwise(0)
    d = merged.withColumns({"__all": F.sum(real).over(groups),
                            "__upto": F.sum(real).over(groups.orderBy(F.col("bucket").asc_nulls_first())
                                                       .rowsBetween(Window.unboundedPreceding, Window.currentRow))})

    def at(rank: Column) -> Column:  # bucket of the row of this rank, from 0
        return F.min(F.when(F.col("__upto") > rank, F.col("bucket")))

    place = (F.col("__all") - 1) * F.lit(0.9)
    low, share = F.floor(place), F.max(place - F.floor(place))
    p90 = at(low) + (at(F.ceil(place)) - at(low)) * share
    return d.groupBy(*by).agg(F.sum("rows").alias("rows"), at(F.floor((F.col("__all") - 1) / 2)).alias("median_len"),
                              F.floor(p90).cast("int").alias("p90_len"), F.max("max_len").alias("max_len"))


# ----------------------------------------------------------------- counts

# Levels of ``stage_counts``, coarse to fine.
STAGE_LEVELS = (("stage",), ("stage", "split"), ("stage", "split", "source"), ("stage", "split", "source", "outcome"))


def stage_counts(tagged: DataFrame) -> DataFrame:
    """Rows in, kept and removed by stage, split, source and outcome, in one pass.

    ``tagged`` has ``(stage, split, source, outcome)`` for every row that enters a
    stage, the outcome being ``kept`` or why it was removed. ``level`` names the
    columns a row counts by (1: stage, ... 4: all); columns beyond it are null.
    One aggregate with grouping sets: counts are made before the shuffle, so a
    source with a third of all rows is no hot key.
    """
    columns = ("stage", "split", "source", "outcome")
    kept = F.sum((F.col("__kept")).cast("bigint"))
    level = F.lit(4) - F.grouping("split") - F.grouping("source") - F.grouping("outcome")
    return tagged.select(*columns, F.col("outcome").eqNullSafe("kept").alias("__kept")) \
        .groupingSets([[F.col(c) for c in s] for s in STAGE_LEVELS], *columns) \
        .agg(level.cast("int").alias("level"), F.count(F.lit(1)).alias("rows_in"),
             kept.alias("rows_kept"), (F.count(F.lit(1)) - kept).alias("rows_removed"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    """Row counts per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
