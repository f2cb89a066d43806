"""Log-likelihood scoring, prediction, accuracy and preference metrics
(K5, K6, A1-A3, A8, A9; entry point C).

The reference loops over examples and choices; here the loops are two
aggregations keyed by example (partial aggregation happens before each
shuffle, so a single example with very many token rows is combined map-side),
and the gold answers are joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..functions import tokens as tk
from ..functions.text import bind_column, letter, strip

NEG_INF = float("-inf")
NO_PREDICTION = "NONE"
MAX_LEN = 1024           # fixed value: longest sequence in ids


def choice_scores(token_logprobs: DataFrame, choices: DataFrame | None = None,
                  example: str = "example_id", choice: str = "choice_idx",
                  logprob: str = "logprob", normalise: str = "sum") -> DataFrame:
    """A1 (+K6): summed log-probability per (example, choice).

    ``choices`` (example, choice) lists every choice that was asked; a choice
    with no scored tokens gets ``-inf``, and so does one that has a row without
    a log-probability. ``normalise="avg"`` divides by the token count (the reference sums).
    """
    agg = F.sum(logprob) if normalise == "sum" else F.avg(logprob)
    if normalise not in ("sum", "avg"):
        raise ValueError("normalise must be 'sum' or 'avg'")
    whole = F.count(logprob) == F.count(F.lit(1))
    s = token_logprobs.groupBy(example, choice).agg(F.when(whole, agg).otherwise(F.lit(NEG_INF)).alias("score"))
    if choices is not None:
        s = (choices.select(example, choice).join(s, [example, choice], "left")
             .select(example, choice, F.coalesce("score", F.lit(NEG_INF)).alias("score")))
    return s


def predict(scores: DataFrame, example: str = "example_id", choice: str = "choice_idx",
            score: str = "score") -> DataFrame:
    """A2: best choice per example; the first index wins ties (all ``-inf`` -> 0)."""
    best = F.max_by(F.col(choice), F.struct(F.col(score), -F.col(choice)))
    return scores.groupBy(example).agg(best.alias("pred_idx"))


def predictions(scores: DataFrame, gold: DataFrame, example: str = "example_id",
                answer: str = "answer", gold_mode: str = "text") -> DataFrame:
    """Per gold example: predicted letter (``NONE`` without choices), normalised
    gold (G10; ``gold_mode="letter"`` reduces it to a letter) and both match flags."""
    p = predict(scores, example)
    g = gold.select(example, fmt.eval_gold(answer, gold_mode).alias("gold"))
    pred = F.coalesce(letter(F.col("pred_idx")), F.lit(NO_PREDICTION))
    return (g.join(p, example, "left")
             .select(example, pred.alias("pred"), "gold",
                     (pred == F.col("gold")).alias("correct"),
                     (strip(pred) == strip(F.col("gold"))).alias("correct_norm")))


def accuracy(preds: DataFrame) -> DataFrame:
    """A3: total, correct, correct_norm, accuracy, accuracy_norm (0.0 when empty)."""
    total = F.count(F.lit(1))
    c = F.sum(F.col("correct").cast("long"))
    cn = F.sum(F.col("correct_norm").cast("long"))
    return preds.agg(total.alias("total"), F.coalesce(c, F.lit(0)).alias("correct"),
                     F.coalesce(cn, F.lit(0)).alias("correct_norm"),
                     F.coalesce(c / total, F.lit(0.0)).alias("accuracy"),
                     F.coalesce(cn / total, F.lit(0.0)).alias("accuracy_norm"))


def token_logprob(df: DataFrame, logits: str, target: str, out: str = "logprob") -> DataFrame:
    """K5: log-softmax of a logit vector evaluated at the target id."""
    return df.withColumn(out, tk.log_softmax_at(F.col(logits), F.col(target)))


def choice_requests(items: DataFrame, prompt: str = "prompt", continuations: str = "continuations",
                    example: str = "example_id", max_len: int = MAX_LEN, eos: str = fmt.EOS) -> DataFrame:
    """K1 + K4: one row per example and choice: ``(example, choice_idx, input_ids, prompt_len)``.

    ``input_ids`` are the ids of prompt + continuation, cut to ``max_len``;
    ``prompt_len`` is the number of ids of the prompt alone, cut alike, so the
    choice's ids are those after it. The end of the prompt may fall inside a
    token of the whole (a continuation without blank grows into the last word), and
    then a choice can have no ids at all. The prompt is tokenised once per
    example: its settled pieces serve every choice, and only the
    rest is tokenised with each continuation. A null prompt or list gives no
    rows, a null continuation counts as empty.
    """
    d = items.select(F.col(example), F.col(prompt).alias("__text"), F.col(continuations).alias("__conts"))
    # a null text has no pieces; asked of the text itself, the prompt would be made twice, once for the filter
    d = bind_column(d, tk.settled_pieces("__text", eos), "__n").where(F.col("__n.pieces").isNotNull())
    d = d.select(example, "__conts", "__n", F.col("__text").substr(F.col("__n.chars") + 1, F.length("__text")).alias("__rest"))
    n_prompt = F.size("__n.pieces") + F.size(tk.pieces("__rest", eos))
    d = d.select(example, "__conts", F.least(n_prompt, F.lit(max_len)).alias("prompt_len"), "__rest",
                 tk.ids_of(F.slice("__n.pieces", 1, max_len), eos).alias("__ids"))
    d = d.select(example, "prompt_len", "__rest", "__ids", F.posexplode("__conts").alias("choice_idx", "__cont"))
    rest = tk.pieces(F.concat("__rest", F.coalesce("__cont", F.lit(""))), eos)
    ids = F.slice(F.concat("__ids", tk.ids_of(F.slice(rest, 1, max_len), eos)), 1, max_len)
    return d.select(example, "choice_idx", ids.alias("input_ids"), "prompt_len")


def scored_positions(requests: DataFrame, example: str = "example_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per id to be scored: ``(example, choice_idx, token_pos, target)`` and the columns ``carry``.

    A choice without ids has one row without position, so that it keeps its place and scores ``-inf``.
    """
    choice = tk.choice_slice(F.col("input_ids"), F.col("prompt_len"))
    return requests.select(example, "choice_idx", *carry, F.posexplode_outer(choice).alias("token_pos", "target")).select(
        example, "choice_idx", "token_pos", "target", *carry)


def choice_loglik(requests: DataFrame, positions: DataFrame, logits: str = "logits", example: str = "example_id") -> DataFrame:
    """K4-K6 in sequence form: the log-likelihood of each choice from the logit vectors of its positions.

    ``positions`` has (example, choice_idx, token_pos, ``logits``), at most one
    row per id of a choice, in any order. They are put together again by
    example and choice, in order, and held against the choice's ids: without ids, or with more
    or fewer vectors than ids, the score is minus infinity.
    """
    rows = positions.where(F.col("token_pos").isNotNull()).groupBy(example, "choice_idx").agg(
        F.array_sort(F.collect_list(F.struct("token_pos", F.col(logits).cast("array<double>").alias("v")))).alias("__rows"))
    targets = tk.choice_slice(F.col("input_ids"), F.col("prompt_len"))
    vectors = F.transform("__rows", lambda r: r["v"])
    return requests.join(rows, [example, "choice_idx"], "left").select(
        example, "choice_idx", F.size(targets).alias("n_targets"), F.coalesce(F.size(vectors), F.lit(0)).alias("n_rows"),
        tk.sequence_logprob(vectors, targets).alias("loglik"))


# ----------------------------------------------------------- preference

REWARD_MODES = ("none", "sum", "avg")


def rewards(pairs: DataFrame, mode: str) -> tuple:
    """(chosen, rejected) reward columns for one normalisation mode.

    ``none``: policy minus reference log-probability; ``sum``: log-probability;
    ``avg``: log-probability per token. ``norm`` has no definition in the
    reference configuration and is rejected.
    """
    if mode == "none":
        return (F.col("chosen_logp") - F.col("ref_chosen_logp"),
                F.col("rejected_logp") - F.col("ref_rejected_logp"))
    if mode == "sum":
        return F.col("chosen_logp"), F.col("rejected_logp")
    if mode == "avg":
        return (F.try_divide("chosen_logp", "chosen_len"),  # null for a length of 0
                F.try_divide("rejected_logp", "rejected_len"))
    raise ValueError(f"unsupported reward normalisation {mode!r}")


def preference_accuracy(pairs: DataFrame, modes: tuple[str, ...] = REWARD_MODES,
                        by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Share of pairs whose chosen reward beats the rejected one, per mode
    and group. One aggregation computes every mode's win rate (partial
    aggregation, one pass); the small result is unpivoted to one row per mode.
    A pair without a reward in a mode (length 0) counts in ``pairs`` but not in the mode's share."""
    wins = []
    for m in modes:
        c, r = rewards(pairs, m)
        wins.append(F.avg((c > r).cast("double")).alias(f"__acc_{m}"))
    agg = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *wins)
    long = agg.unpivot([*by, "pairs"], [f"__acc_{m}" for m in modes], "mode", "accuracy")
    return long.select(F.regexp_replace("mode", "^__acc_", "").alias("mode"), *by, "pairs", "accuracy")
