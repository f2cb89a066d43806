"""Streaming curation: the stateless row-wise operators on ``readStream``.

Every curation and formatting operator is a per-row projection or filter, so
the same functions run unchanged on a file stream. New source files are
curated incrementally into a Parquet sink; the sink's progress is kept in a
checkpoint below the shared ``spark.checkpoint.dir``, so a restarted or
failed query resumes where it stopped without duplicates (file sink +
checkpoint give exactly-once output).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import curate
from ..operators import tokenise

CURATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "boxed": curate.curate_boxed,
    "distractor": curate.curate_distractor,
    "optlist": curate.curate_optlist,
    "fourcol": curate.curate_fourcol,
}


def curate_stream(spark: SparkSession, kind: str, source_dir: str, schema: StructType | str,
                  sink_dir: str, checkpoint: str | None = None, format_mode: str | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Curate Parquet files arriving in ``source_dir`` into ``sink_dir``.

    ``format_mode`` ("rationale" / "answer_only") also renders training text.
    ``available_now=True`` processes everything present and stops (a batch
    catch-up with streaming bookkeeping); otherwise the query keeps running.
    """
    from ..session import checkpoint_dir

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    out = CURATORS[kind](src)
    if format_mode:
        out = tokenise.format_rows(out, mode=format_mode)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/curate-{kind}"
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
                 .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
