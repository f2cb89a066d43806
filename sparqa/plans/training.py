"""Entry point B: training rows from the curated dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import curate, sampling, tokenise
from ..sources import fixtures
from . import curation


def training_rows(spark: SparkSession, root: str, split: str = "train", mode: str = "rationale",
                  max_len: int | None = None, cache: bool = True,
                  observation: Observation | None = None) -> DataFrame:
    """Curated split -> formatted text -> token ids and masked labels -> rows
    with a target (F4), built once and read back from the shared checkpoint
    folder (S5; keyed by input files, split, format, length and code). Whole texts
    unless ``max_len`` is given.

    ``observation`` (only when the table is built) reports the rows removed by F4.
    """
    from ..session import checkpoint_dir
    from ..sources.sinks import input_fingerprint, materialise_once

    def build() -> DataFrame:
        data = curation.materialised_dataset(spark, root).where(f"split = '{split}'")
        rows = tokenise.tokenise(tokenise.format_rows(data, mode=mode), max_len)
        return tokenise.label_filter(rows, observation=observation).select(
            "row_id", "source", "input_ids", "labels", "n_tokens", "response_start", "boundary_lost")

    if not cache:
        return build()
    opts = {"root": root, "split": split, "mode": mode, "max_len": max_len,
            "input": input_fingerprint(spark, root), "code": curation._code_fingerprint(), "namespace": curation.cache_namespace(spark)}
    base = f"{checkpoint_dir(spark).rstrip('/')}/sparqa-training"
    return materialise_once(spark, base, build, opts)


def stage_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every row that enters a stage of entry points A and B, as ``(stage, split, source, outcome)`` for ``profile.stage_counts``.

    ``curate``: all source rows (no split yet); ``split``: the rows of the
    dataset; ``label``: the same rows once tokenised, kept where a label is left (F4).
    """
    sources = {"boxed": fixtures.boxed_source, "distractor": fixtures.distractor_source,
               "optlist": fixtures.optlist_source, "fourcol": fixtures.fourcol_source}
    tagged = [curate.outcome(make(spark, root), kind).select(F.lit("curate").alias("stage"), F.lit("").alias("split"), "source", "outcome")
              for kind, make in sources.items()]
    data = curation.materialised_dataset(spark, root)
    rows = tokenise.tokenise(tokenise.format_rows(data, keep=("row_id", "source", "split")))
    # a row of the dataset stands in two stages: both tags are made of the one pass that tokenises it
    outcome = F.when(tk.has_target(F.col("labels")), "kept").otherwise("no_target")
    both = F.array(F.struct(F.lit("split").alias("stage"), F.lit("kept").alias("outcome")),
                   F.struct(F.lit("label").alias("stage"), outcome.alias("outcome")))
    tagged.append(rows.select("split", "source", F.inline(both)).select("stage", "split", "source", "outcome"))
    return sampling.concat_tables(tagged)
