"""Entry point C: multiple-choice evaluation by summed log-likelihood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import formatting as fmt
from ..operators import evaluation as ev
from pyspark.sql import functions as F


def eval_requests(items: DataFrame, example: str = "example_id", topic: str = fmt.EVAL_TOPIC) -> DataFrame:
    """Per evaluation item: the prompt and one continuation per choice (first
    26), exploded to ``(example_id, choice_idx, prompt, continuation)`` for an
    external scorer that returns per-token log-probabilities."""
    d = items.select(example, fmt.eval_prompt("question", "choices", topic).alias("prompt"),
                     fmt.eval_continuations("choices").alias("conts"))
    return d.select(example, "prompt", F.posexplode("conts").alias("choice_idx", "continuation"))


def evaluate(token_logprobs: DataFrame, gold: DataFrame, choices: DataFrame | None = None,
             normalise: str = "sum", gold_mode: str = "text") -> DataFrame:
    """Scores (A1, K6) -> first-best prediction (A2) -> accuracy (A3), one row."""
    scores = ev.choice_scores(token_logprobs, choices, normalise=normalise)
    return ev.accuracy(ev.predictions(scores, gold, gold_mode=gold_mode))


def mcq_eval(items: DataFrame, score: Callable[[DataFrame], DataFrame], example: str = "example_id", topic: str = fmt.EVAL_TOPIC,
             max_len: int = ev.MAX_LEN, gold_mode: str = "text", normalise: str = "sum") -> DataFrame:
    """Entry point C as one plan, from (example, question, choices, answer) to accuracy.

    Prompts and continuations (G9), token ids of every choice (K1, K4), ``score``
    (a model: ``choice_requests`` in, a ``logprob`` for each of ``scored_positions`` out),
    sums per choice (A1, K6), the best choice (A2) and the accuracy (A3).
    """
    texts = items.select(example, fmt.eval_prompt("question", "choices", topic).alias("prompt"),
                         fmt.eval_continuations("choices").alias("continuations"))
    logprobs = score(ev.choice_requests(texts, example=example, max_len=max_len))
    gold = items.select(example, "answer")
    return ev.accuracy(ev.predictions(ev.choice_scores(logprobs, example=example, normalise=normalise), gold, example, gold_mode=gold_mode))
