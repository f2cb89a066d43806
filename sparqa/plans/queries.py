"""Registered queries: one per operator group of the survey, each over whole tables.

Every function takes ``(spark, root)`` where ``root`` is a folder holding the
driver tables, and returns a lazy DataFrame. ``sparqa.plans.oracle`` holds the
matching DuckDB SQL under the same name.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..functions.text import bind_column, strip
from ..operators import chat, curate, evaluation, profile, retrieval, sampling, tokenise
from ..sources import fixtures
from ..sources.sinks import stored
from ..sources.tables import spread, table
from . import curation, training
from . import evaluation as evaluation_plan

Query = Callable[[SparkSession, str], DataFrame]

# Rows of the exact sample, which is its feature.
SAMPLE_ROWS = 10000


def curate_boxed(spark: SparkSession, root: str) -> DataFrame:
    return curate.curate_boxed(fixtures.boxed_source(spark, root))


def curate_distractor(spark: SparkSession, root: str) -> DataFrame:
    return curate.curate_distractor(fixtures.distractor_source(spark, root))


def curate_optlist(spark: SparkSession, root: str) -> DataFrame:
    return curate.curate_optlist(fixtures.optlist_source(spark, root))


def curate_fourcol(spark: SparkSession, root: str) -> DataFrame:
    return curate.curate_fourcol(fixtures.fourcol_source(spark, root))


def curate_union(spark: SparkSession, root: str) -> DataFrame:
    return curation.curated_union(spark, root)


def source_counts(spark: SparkSession, root: str) -> DataFrame:
    """Curated rows per source."""
    return profile.counts_by(curate_union(spark, root), "source")


# ------------------------------------------------------------- sampling

def _orders(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


def sample_exact(spark: SparkSession, root: str) -> DataFrame:
    return sampling.sample_exact(_orders(spark, root), "o_orderkey", SAMPLE_ROWS,
                                 curation.SEED)


def shuffle_rank(spark: SparkSession, root: str) -> DataFrame:
    return sampling.with_position(_orders(spark, root).select("o_orderkey"), "o_orderkey",
                                  "pos", order="hash", seed=curation.SEED)


def split_95(spark: SparkSession, root: str) -> DataFrame:
    return sampling.split_train_test(_orders(spark, root).select("o_orderkey"), "o_orderkey",
                                     curation.TRAIN_FRACTION, seed=curation.SEED)


# Evaluation shard layout (first of ten contiguous shards).
NUM_SHARDS = 10


def shard_contiguous(spark: SparkSession, root: str) -> DataFrame:
    return sampling.shard_index(_orders(spark, root).select("o_orderkey"), "o_orderkey",
                                NUM_SHARDS, order="key")


def shard_exclude(spark: SparkSession, root: str) -> DataFrame:
    """Every row outside the first of ten contiguous shards."""
    return sampling.shard(_orders(spark, root), "o_orderkey", NUM_SHARDS, 0, exclude=True)


def split_stratified(spark: SparkSession, root: str) -> DataFrame:
    """R4 within every customer: strata by the thousand, most of a few rows."""
    return sampling.split_train_test(_orders(spark, root).select("o_orderkey", "o_custkey"), "o_orderkey",
                                     curation.TRAIN_FRACTION, seed=curation.SEED, stratify=("o_custkey",))


# ------------------------------------------------------- formatting

def format_answer_only(spark: SparkSession, root: str) -> DataFrame:
    return tokenise.format_rows(curate_fourcol(spark, root), mode="answer_only")


def parse_choices(spark: SparkSession, root: str) -> DataFrame:
    """G2 + G3 over the curated union: question body and lettered choices."""
    d = bind_column(curate_union(spark, root), strip("question"), "__q")
    return d.select("row_id", fmt.question_body("__q").alias("body"),
                    fmt.parse_choices("__q").alias("choices"))


def format_rationale(spark: SparkSession, root: str) -> DataFrame:
    return tokenise.format_rows(curate_union(spark, root), mode="rationale")


def length_profile(spark: SparkSession, root: str) -> DataFrame:
    return profile.length_profile(format_rationale(spark, root), "text", by="source")


def length_profile_merge(spark: SparkSession, root: str) -> DataFrame:
    """A4-A6 from stored states, one for each split of the dataset, merged per source."""
    data = curation.materialised_dataset(spark, root)
    states = []
    for split in ("train", "test"):
        rows = tokenise.format_rows(data.where(F.col("split") == split), keep=("row_id", "source", "split"))
        states.append(stored(profile.length_state(rows), f"lengths-{split}"))
    return profile.profile_of_state(profile.merge_states(*states), "source")


# ------------------------------------------------------------ tokens

def _tokenised(spark: SparkSession, root: str) -> DataFrame:
    return tokenise.tokenise(format_rationale(spark, root))


def tokenise_default(spark: SparkSession, root: str) -> DataFrame:
    return _tokenised(spark, root).select("row_id", "input_ids", "n_tokens")


def tokenise_padded(spark: SparkSession, root: str) -> DataFrame:
    """K1 at the training length: ids, attention mask and labels cut or padded to 1024, as checksums of their lists."""
    t = tokenise.tokenise(format_rationale(spark, root), tokenise.MAX_LEN_RATIONALE, pad=True)
    check = lambda c: F.md5(F.btrim(F.to_json(c), F.lit("[]")))  # noqa: E731  (numbers joined by commas, without a string for each)
    return t.select("row_id", "n_tokens", F.size("input_ids").alias("width"), check("input_ids").alias("input_ids"),
                    check("attention_mask").alias("attention_mask"), check("labels").alias("labels"))


def mask_labels(spark: SparkSession, root: str) -> DataFrame:
    return _tokenised(spark, root).select("row_id", "response_start", "labels", "boundary_lost")


def label_filter(spark: SparkSession, root: str) -> DataFrame:
    return tokenise.label_filter(_tokenised(spark, root)).select("row_id", "n_tokens")


# ------------------------------------------------------------------- chat

def chat_render(spark: SparkSession, root: str) -> DataFrame:
    sft = fixtures.sft_pairs(spark, root)
    text = fmt.render_chat([("user", F.col("prompt")), ("assistant", F.col("target"))])
    return sft.select("conv_id", "turn", text.alias("text"))


def chat_conversations(spark: SparkSession, root: str) -> DataFrame:
    """G8 over whole conversations: every turn of every role as a fragment of the rendered text."""
    return chat.conversation_fragments(spread(table(spark, root, "conversations")))


# ------------------------------------------------- evaluation

def eval_prompt(spark: SparkSession, root: str) -> DataFrame:
    e = fixtures.eval_questions(spark, root)
    return e.select("example_id", fmt.eval_prompt("question", "choices").alias("prompt"),
                    fmt.eval_continuations("choices").alias("continuations"),
                    fmt.eval_gold("answer").alias("gold"),
                    F.size("choices").alias("n_choices"),
                    (F.size("choices") > fmt.MAX_LETTERS).alias("overflow"))


def choice_scores(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.choice_scores(fixtures.token_logprobs(spark, root))


def mcq_predict(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.predictions(choice_scores(spark, root), fixtures.gold_answers(spark, root))


def mcq_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.accuracy(mcq_predict(spark, root))


def token_logprob_gather(spark: SparkSession, root: str) -> DataFrame:
    """K5: each embedding read as a logit vector, scored at its label."""
    e = spread(table(spark, root, "embeddings"))
    d = evaluation.token_logprob(e, "embedding", "label")
    return d.select("vec_id", "label", F.round("logprob", 6).alias("logprob"))


def choice_loglik(spark: SparkSession, root: str) -> DataFrame:
    """K1, K4-K6: every document as a prompt with four continuations, scored from sequences of logit vectors.
    Of every eleventh document the last vector is missing."""
    req = stored(evaluation.choice_requests(fixtures.passage_questions(spark, root)), "requests")  # read twice
    rows = fixtures.with_logits(req, spark, root)
    rows = rows.where((F.col("example_id") % 11 != 0) | (F.col("token_pos") != 0))
    width = F.lit(fixtures.vector_size(spark, root))
    req = req.withColumn("input_ids", F.transform("input_ids", lambda x: x % width))
    scored = evaluation.choice_loglik(req, rows)
    return scored.select("example_id", "choice_idx", "n_targets", "n_rows", F.round("loglik", 6).alias("loglik"))


def mcq_eval(spark: SparkSession, root: str) -> DataFrame:
    """Entry point C from question texts to accuracy, the log-probabilities from a stand-in model."""
    def score(requests: DataFrame) -> DataFrame:
        rows = fixtures.with_logits(requests, spark, root)
        return evaluation.token_logprob(rows, "logits", "target").select("example_id", "choice_idx", "token_pos", "logprob")
    return evaluation_plan.mcq_eval(fixtures.eval_questions(spark, root), score)


def preference_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.preference_accuracy(fixtures.preference_pairs(spark, root))


# -------------------------------------------------------- retrieval

def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.chunk_documents(spread(table(spark, root, "documents")))


# The cap of the capped form, which is its feature; small enough to cut at the test sizes.
FIRST_CHUNKS = 500


def chunk_first_n(spark: SparkSession, root: str) -> DataFrame:
    """The first chunks of all documents in order of document and chunk."""
    return retrieval.chunk_documents(spread(table(spark, root, "documents")), max_chunks=FIRST_CHUNKS)


def _embeddings(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "embeddings").select("vec_id", "embedding"))


def retrieve_cosine(spark: SparkSession, root: str) -> DataFrame:
    """Nearest two other vectors of every vector by cosine similarity."""
    e = _embeddings(spark, root)
    return retrieval.retrieve_vectors(e, e, sim="cosine", exclude_self=True) \
        .withColumnRenamed("vec_id", "doc_id")


def retrieve_dot(spark: SparkSession, root: str) -> DataFrame:
    """Nearest two other vectors of every vector by inner product."""
    e = _embeddings(spark, root)
    return retrieval.retrieve_vectors(e, e, sim="dot_product", exclude_self=True) \
        .withColumnRenamed("vec_id", "doc_id")


def retrieve_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Top two document chunks of every benchmark item by token-set Jaccard."""
    chunks = chunk_documents(spark, root)
    items = table(spark, root, "benchmark")
    return retrieval.retrieve_text(items, chunks, "item_id", "text", ["doc_id", "chunk_idx"], "text")


# ----------------------------------------------------------- sinks

def write_read_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """The curated, shuffled, split table written once as Parquet and read back."""
    return curation.materialised_dataset(spark, root).select(
        "row_id", "question", "reasoning", "answer", "source", "split")


def training_rows(spark: SparkSession, root: str) -> DataFrame:
    """Entry point B end to end: train split, rationale format, token ids,
    masked labels, rows with a target; built once into the shared folder."""
    return training.training_rows(spark, root, "train", "rationale").select(
        "row_id", "input_ids", "labels", "n_tokens")


def training_rows_test(spark: SparkSession, root: str) -> DataFrame:
    """Entry point B for the test split."""
    return training.training_rows(spark, root, "test", "rationale").select(
        "row_id", "input_ids", "labels", "n_tokens")


def stage_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows in, kept and removed by stage, split, source and reason."""
    return profile.stage_counts(training.stage_rows(spark, root))


QUERIES: dict[str, Query] = {
    "curate_boxed": curate_boxed,
    "curate_distractor": curate_distractor,
    "curate_optlist": curate_optlist,
    "curate_fourcol": curate_fourcol,
    "curate_union": curate_union,
    "source_counts": source_counts,
    "sample_exact": sample_exact,
    "shuffle_rank": shuffle_rank,
    "split_95": split_95,
    "shard_contiguous": shard_contiguous,
    "shard_exclude": shard_exclude,
    "split_stratified": split_stratified,
    "format_answer_only": format_answer_only,
    "parse_choices": parse_choices,
    "format_rationale": format_rationale,
    "length_profile": length_profile,
    "length_profile_merge": length_profile_merge,
    "tokenise_default": tokenise_default,
    "tokenise_padded": tokenise_padded,
    "mask_labels": mask_labels,
    "label_filter": label_filter,
    "chat_render": chat_render,
    "chat_conversations": chat_conversations,
    "eval_prompt": eval_prompt,
    "choice_scores": choice_scores,
    "mcq_predict": mcq_predict,
    "mcq_accuracy": mcq_accuracy,
    "token_logprob_gather": token_logprob_gather,
    "choice_loglik": choice_loglik,
    "mcq_eval": mcq_eval,
    "preference_accuracy": preference_accuracy,
    "chunk_documents": chunk_documents,
    "chunk_first_n": chunk_first_n,
    "retrieve_cosine": retrieve_cosine,
    "retrieve_dot": retrieve_dot,
    "retrieve_jaccard": retrieve_jaccard,
    "write_read_roundtrip": write_read_roundtrip,
    "training_rows": training_rows,
    "training_rows_test": training_rows_test,
    "stage_counts": stage_counts,
}


def oracle_sql() -> dict[str, str]:
    from . import oracle
    return {name: getattr(oracle, name)() for name in QUERIES if hasattr(oracle, name)}
