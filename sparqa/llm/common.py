"""Helpers shared by the operators: tables in the shared folder, word rules, Arrow kernels."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparqa.session import checkpoint_dir, ship_package
from sparqa.sources.tables import table

__all__ = ["SPACE_RE", "arrow_map", "met_by_key", "saved", "scratch_path", "split_words", "table", "text_slices"]

#: What separates words (space and the controls 9 to 13), as a Java pattern.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch that a text kernel takes at a time.
SLICE_ROWS = 512
#: Bytes of text that such a kernel takes at a time, unless one text alone has more.
SLICE_BYTES = 4 << 20

_MADE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver exits."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_scratch)
    _MADE.append((spark, path))
    return path


def _remove_scratch() -> None:
    for spark, path in _MADE:
        sc = spark.sparkContext
        if sc._jsc is None:  # the session has ended
            continue
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    _MADE.clear()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later steps then depend on files that every executor sees, not on shuffle
    output of an executor that may be lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more rows than this, and than such a share of all rows, hold go to all tasks; there are at most ``HOT_SHARE``.
HOT_ROWS = 10_000
HOT_SHARE = 1024


def met_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each value of ``key`` and in ``count`` the rows that hold it.

    The at most ``HOT_SHARE`` values that many rows hold are broadcast; no task
    gets more than ``HOT_ROWS`` rows, or that share of all, of any other value. ``facts`` are read twice.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(HOT_ROWS, -(-int(total) // HOT_SHARE))
    many = facts.where(hot)
    if not many.take(1):
        return rows.join(facts, key)
    return rows.join(F.broadcast(many), key).unionByName(
        rows.join(F.broadcast(many.select(key)), key, "left_anti").join(facts.where(~hot), key))


def split_words(text: Column) -> Column:
    """The words of a text in order, as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def text_slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut after ``rows`` rows or ``SLICE_BYTES`` of ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = sizes.astype("int64").cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = min(max(int(ends.searchsorted(done + SLICE_BYTES, "right")), at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, kernel: Callable[..., dict[str, object]], schema: str, columns: Iterable[str],
              carry: Iterable[str] = ()) -> DataFrame:
    """Apply ``kernel(*lists) -> {column: values}`` to small slices of each partition.

    Slices hold at most ``SLICE_ROWS`` rows, so that the Python lists and the
    result of one call stay small also where texts are long. ``carry`` names
    columns that go through as they are, for kernels that give a row per row.
    """
    ship_package(df.sparkSession)
    names, kept = list(columns), list(carry)
    made = StructType.fromDDL(schema)
    fields = [(f.name, _arrow_type(f.dataType.simpleString())) for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                column = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                got = kernel(*(column[n].to_pylist() for n in names))
                yield pa.RecordBatch.from_arrays([*(column[n] for n in kept), *(pa.array(got[n], type=t) for n, t in fields)],
                                                 names=[*kept, *(n for n, _ in fields)])

    every = list(dict.fromkeys([*names, *kept]))
    out = StructType([*(df.schema[n] for n in kept), *made.fields])
    return df.select(*every).mapInArrow(run, out)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
            "double": pa.float64(), "boolean": pa.bool_()}[kind]
