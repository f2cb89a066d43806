"""Per-source projection to the canonical question table.

Canonical schema: ``row_id BIGINT, question, reasoning, answer, source STRING``.
Rows the reference would crash on (null inputs, malformed options, answer
index out of range) are rejected here; pass an ``Observation`` to count them
alongside the main job without an extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import options as opt
from ..functions.answers import extract_answer
from ..functions.text import bind_column

CANONICAL = ("row_id", "question", "reasoning", "answer", "source")

# Provenance tags of the three sources that carry no source column.
TAG_DISTRACTOR = "SciQ"
TAG_OPTLIST = "AQUA-RAT"
TAG_FOURCOL = "MedMCQA"

# Source number folded into row_id so ids from different sources never collide.
SOURCE_NO = {"boxed": 0, "distractor": 1, "optlist": 2, "fourcol": 3}


def row_id(key: Column | str, kind: str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (k.cast("long") * 4 + F.lit(SOURCE_NO[kind])).alias("row_id")


def _observe(df: DataFrame, observation: Observation | None, bad: Column) -> DataFrame:
    if observation is None:
        return df
    return df.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                      F.sum(F.when(bad, 1).otherwise(0)).alias("rows_removed"))


def _canonical(question: Column, reasoning: Column, answer: Column, source: Column,
               rid: Column) -> list[Column]:
    return [rid, question.alias("question"), reasoning.alias("reasoning"),
            answer.alias("answer"), source.alias("source")]


# ---------------------------------------------- why a row is left out (null: it is kept)

def boxed_fault(answer: Column, problem: str = "problem", solution: str = "solution") -> Column:
    return (F.when(F.col(problem).isNull() | F.col(solution).isNull(), "null_input")
             .when(answer.isNull(), "no_answer"))


def distractor_fault(question: str = "question", correct: str = "correct_answer") -> Column:
    return F.when(F.col(question).isNull() | F.col(correct).isNull(), "null_input")


def optlist_fault(question: str = "question", options: str = "options", correct: str = "correct") -> Column:
    return (F.when(F.col(question).isNull() | F.col(options).isNull() | F.col(correct).isNull(), "null_input")
             .when(~F.coalesce(opt.options_well_formed(options), F.lit(False)), "malformed_options"))


def fourcol_fault(question: str = "question", cols: tuple[str, str, str, str] = ("opa", "opb", "opc", "opd"),
                  answer_index: str = "cop", explanation: str = "exp", choice_type: str = "choice_type") -> Column:
    answer = opt.answer_by_index(F.col(answer_index), *(F.col(c) for c in cols))
    return (F.when(F.col(explanation).isNull(), "no_explanation")
             .when(~F.col(choice_type).eqNullSafe("single"), "not_single")
             .when(F.col(question).isNull(), "null_input")
             .when(answer.isNull(), "no_answer"))


def outcome(df: DataFrame, kind: str) -> DataFrame:
    """``(source, outcome)`` of every row of a question source; the outcome is ``kept`` or why it is left out."""
    if kind == "boxed":
        d = bind_column(df, extract_answer("solution", "problem"), "__ans")
        fault, source = boxed_fault(F.col("__ans")), F.col("source")
    else:
        d = df
        fault, tag = {"distractor": (distractor_fault, TAG_DISTRACTOR), "optlist": (optlist_fault, TAG_OPTLIST),
                      "fourcol": (fourcol_fault, TAG_FOURCOL)}[kind]
        fault, source = fault(), F.lit(tag)
    return d.select(source.alias("source"), F.coalesce(fault, F.lit("kept")).alias("outcome"))


def curate_boxed(df: DataFrame, key: str = "doc_id", problem: str = "problem",
                 solution: str = "solution", source: str = "source",
                 observation: Observation | None = None, strict_letter: bool = False) -> DataFrame:
    """Free-form solutions: extract the answer (X1-X6) and drop rows without one."""
    d = bind_column(df, extract_answer(solution, problem, strict_letter), "__ans")
    bad = F.col("__ans").isNull()    # a null problem or solution already yields a null answer
    d = _observe(d, observation, bad)
    return d.where(~bad).select(*_canonical(F.col(problem), F.col(solution), F.col("__ans"),
                                            F.col(source), row_id(key, "boxed")))


def curate_distractor(df: DataFrame, key: str = "p_partkey", question: str = "question",
                      distractors: tuple[str, ...] = ("distractor1", "distractor2", "distractor3"),
                      correct: str = "correct_answer", support: str = "support",
                      seed: int = 42, observation: Observation | None = None) -> DataFrame:
    """Answer + three distractors: seeded shuffle, lettered options."""
    bad = distractor_fault(question, correct).isNotNull()
    d = _observe(df, observation, bad).where(~bad)
    text, answer = opt.shuffle_options([F.col(c) for c in distractors] + [F.col(correct)],
                                       F.col(correct), seed, F.col(key))
    return d.select(*_canonical(opt.with_options(question, text), F.col(support), answer,
                                F.lit(TAG_DISTRACTOR), row_id(key, "distractor")))


def curate_optlist(df: DataFrame, key: str = "o_orderkey", question: str = "question",
                   options: str = "options", rationale: str = "rationale", correct: str = "correct",
                   observation: Observation | None = None) -> DataFrame:
    """``"A)21"`` option lists reformatted to ``"A: 21"`` lines."""
    bad = optlist_fault(question, options, correct).isNotNull()
    d = _observe(df, observation, bad).where(~bad)
    d = bind_column(d, opt.option_list(options, correct), "__both")
    return d.select(*_canonical(opt.with_options(question, F.col("__both.text")), F.col(rationale), F.col("__both.answer"),
                                F.lit(TAG_OPTLIST), row_id(key, "optlist")))


def fourcol_prefilter(df: DataFrame, explanation: str = "exp",
                      choice_type: str = "choice_type") -> DataFrame:
    """F1 + F2: keep rows with an explanation and a single-answer choice type."""
    return df.where(F.col(explanation).isNotNull() & (F.col(choice_type) == "single"))


def curate_fourcol(df: DataFrame, key: str = "c_custkey", question: str = "question",
                   cols: tuple[str, str, str, str] = ("opa", "opb", "opc", "opd"),
                   answer_index: str = "cop", explanation: str = "exp",
                   prefiltered: bool = False, observation: Observation | None = None) -> DataFrame:
    """Four option columns + answer index."""
    d = df if prefiltered else fourcol_prefilter(df, explanation)
    a, b, c, dd = (F.col(x) for x in cols)
    answer = opt.answer_by_index(F.col(answer_index), a, b, c, dd)
    d = d.withColumn("__ans", answer)
    bad = F.col(question).isNull() | F.col("__ans").isNull()
    d = _observe(d, observation, bad).where(~bad)
    return d.select(*_canonical(opt.with_options(question, opt.render_four(a, b, c, dd)),
                                F.col(explanation), F.col("__ans"), F.lit(TAG_FOURCOL),
                                row_id(key, "fourcol")))
