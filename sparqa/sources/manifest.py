"""Dataset manifest: a JSON object mapping a role to a dataset id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, suffix: str = "_dataset_repo_id") -> DataFrame:
    """``{"<role>_dataset_repo_id": "<id>", ...}`` -> rows ``(role, dataset_id)``.

    The object's keys become rows (``stack`` over the columns Spark infers),
    and the common key suffix is dropped to give the role name.
    """
    raw = spark.read.option("multiLine", True).json(path)
    cols = raw.columns
    stacked = raw.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols])))
        .alias("key", "dataset_id"))
    role = F.when(F.col("key").endswith(suffix),
                  F.expr(f"substr(key, 1, length(key) - {len(suffix)})")).otherwise(F.col("key"))
    return stacked.select(role.alias("role"), "dataset_id")
