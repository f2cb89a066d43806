"""Sinks: Parquet write, build-once materialisation, preview."""

from __future__ import annotations

import atexit
import hashlib
import json
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write Parquet (the output folder is created by the writer)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back, for plans that need it more than once.

    Cuts the lineage without RDDs: later steps depend on files that every
    executor sees. The files are removed when the driver exits.
    """
    from ..session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{name}-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(_remove_stored)
    _STORED.append((spark, path))
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_stored() -> None:
    for spark, path in _STORED:
        if spark.sparkContext._jsc is not None:
            fs, p = _place(spark, path)
            fs.delete(p, True)
    _STORED.clear()


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_fingerprint(spark: SparkSession, root: str) -> str:
    """A hash over names, lengths and times of change of all files below ``root``."""
    fs, p = _place(spark, root)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def options_key(options: dict) -> str:
    """A short stable hash of build options, used in the cache path."""
    blob = json.dumps(options, sort_keys=True, default=str).encode()
    return hashlib.sha1(blob).hexdigest()[:16]


def materialise_once(spark: SparkSession, base: str, build: Callable[[], DataFrame],
                     options: dict | None = None,
                     partition_by: list[str] | None = None) -> DataFrame:
    """The table published under ``base/<options-hash>``, built and published first if there is none.

    The path includes a hash of the options, so a changed option never reuses a
    stale build. A build is written to a folder of its own, then published by
    one empty file whose name holds the folder's; nothing is renamed or written
    over, so this holds on object stores too. Readers follow the oldest such
    file and see whole builds only. A builder that dies leaves a folder that no
    file names. Of two builders at a time both finish and publish; readers agree on one.
    The result is read from storage, so later stages do not recompute (and do
    not depend on) the build's lineage.
    """
    place = f"{base.rstrip('/')}/{options_key(options or {})}"
    at = published(spark, place)
    if at is None:
        name = f"build-{uuid.uuid4().hex}"
        write_table(build(), f"{place}/{name}", partition_by=partition_by)
        fs, pointer = _place(spark, f"{place}/{POINTER}{name}")
        fs.create(pointer, False).close()
        at = published(spark, place)
    return spark.read.parquet(at)


# Begins the name of the empty file that publishes a build; the build's name follows.
POINTER = "_CURRENT."


def published(spark: SparkSession, place: str) -> str | None:
    """The folder of the build published at ``place``, if any: the one whose file is the oldest."""
    fs, p = _place(spark, place)
    if not fs.exists(p):
        return None
    found = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().startswith(POINTER)]
    return f"{place}/{min(found)[1][len(POINTER):]}" if found else None


def preview(df: DataFrame, n: int = 1, order_by: str | None = "row_id") -> DataFrame:
    """The first ``n`` rows by ``order_by`` (a top-n, not a full sort)."""
    if order_by and order_by in df.columns:
        df = df.orderBy(F.col(order_by))
    return df.limit(n)
