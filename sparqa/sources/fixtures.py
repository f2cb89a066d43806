"""Question-set sources derived from the driver tables.

The reference reads four public question sets of different shapes. The
driver's tables stand in for them: each builder below re-shapes a whole driver
table into one source schema, so the work grows with the table. The same
definitions are written as SQL in ``sparqa.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators.evaluation import scored_positions
from .tables import spread, table

BS = "\\"  # a single backslash


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def boxed_source(spark: SparkSession, root: str) -> DataFrame:
    """problem/solution/source rows with eight answer shapes (boxed, conclusion,
    end-of-proof marker, nothing, deep box, number, letters in words, two boxes).

    The whole document text is part of both problem and solution, so every
    extraction pattern scans complete texts.
    """
    d = spread(table(spark, root, "documents").select("doc_id", "text", "source"))
    k = F.col("doc_id") % 8
    tail = (F.when(k == 0, F.lit(f"So ${BS}boxed{{{BS}text{{B}}}}$ holds"))
             .when(k == 1, F.lit("step\nconclusion: C"))
             .when(k == 2, F.lit(f"one\nD is left\nso ${BS}blacksquare$"))
             .when(k == 3, F.lit("no final answer"))
             .when(k == 4, F.lit(f"{BS}boxed{{{{x{{y}}}}}}"))
             .when(k == 5, F.lit(f"{BS}boxed{{42}}"))
             .when(k == 6, F.lit("Conclusion - the Answer is B"))
             .otherwise(F.lit(f"{BS}boxed{{A}} then {BS}boxed{{B}}")))
    problem = F.concat(_s("doc_id"), F.lit(" "), F.col("text"),
                       F.lit("\nA: a"), _s(F.col("doc_id") % 7),
                       F.lit("\nB: b"), _s(F.col("doc_id") % 5),
                       F.lit("\nC: c\nD: d"))
    solution = F.concat(F.col("text"), F.lit("\n"), tail)
    return d.select("doc_id", problem.alias("problem"), solution.alias("solution"), "source")


def distractor_source(spark: SparkSession, root: str) -> DataFrame:
    """question, three distractors, correct answer, support (every 50th row has a
    distractor equal to the answer, every 10th an empty support)."""
    p = spread(table(spark, root, "part"))
    key = F.col("p_partkey")
    return p.select(
        key,
        F.concat(F.lit("Which size fits "), F.col("p_name"), F.lit("?")).alias("question"),
        _s(F.col("p_size") + 1).alias("distractor1"),
        _s(F.col("p_size") + 2).alias("distractor2"),
        F.when(key % 50 == 0, _s("p_size")).otherwise(_s(F.col("p_size") + 3)).alias("distractor3"),
        _s("p_size").alias("correct_answer"),
        F.when(key % 10 == 0, F.lit("")).otherwise(
            F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("support"))


def optlist_source(spark: SparkSession, root: str) -> DataFrame:
    """question, option list ``"A)..."`` (with ``)`` inside a value and blanks), rationale, letter."""
    o = spread(table(spark, root, "orders"))
    key = F.col("o_orderkey")
    return o.select(
        key,
        F.concat(F.lit("Total of order "), _s(key), F.lit("?")).alias("question"),
        F.array(F.concat(F.lit("A)"), _s("o_custkey")),
                F.concat(F.lit("B) "), F.col("o_orderpriority")),
                F.concat(F.lit("C)f("), _s(key % 9), F.lit(")")),
                F.concat(F.lit("D)"), F.col("o_orderstatus")),
                F.lit("E)none")).alias("options"),
        F.concat(F.lit("because "), F.col("o_orderpriority")).alias("rationale"),
        F.substring(F.lit("ABCDE"), (key % 5 + 1).cast("int"), 1).alias("correct"))


def fourcol_source(spark: SparkSession, root: str) -> DataFrame:
    """question, four option columns, answer index, explanation (some null),
    choice type (some multi)."""
    c = spread(table(spark, root, "customer"))
    key = F.col("c_custkey")
    return c.select(
        key,
        F.concat(F.lit("Segment of "), F.col("c_name"), F.lit("?")).alias("question"),
        F.lit("AUTO").alias("opa"), F.lit("BUILD").alias("opb"),
        F.col("c_mktsegment").alias("opc"), F.lit("none").alias("opd"),
        (key % 4).cast("int").alias("cop"),
        F.when(key % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("see "), F.col("c_mktsegment"))).alias("exp"),
        F.when(key % 5 == 0, F.lit("multi")).otherwise(F.lit("single")).alias("choice_type"))


def token_logprobs(spark: SparkSession, root: str) -> DataFrame:
    """Per (example, choice, token) log-probabilities: exact binary fractions, so
    sums do not depend on order; scores tie for some examples. Generated with
    ``explode`` (no join)."""
    o = spread(table(spark, root, "orders").select("o_orderkey"))
    key = F.col("o_orderkey")
    g = (o.withColumn("choice_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
          .withColumn("token_pos", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    g = g.where(~((F.col("token_pos") == 1) & (F.col("choice_idx") == key % 4)))
    lp = -((key * 7919 + F.col("choice_idx") * 104729 + F.col("token_pos") * 31) % 64).cast("double") / 8
    return g.select(key.alias("example_id"), "choice_idx", "token_pos", lp.alias("logprob"))


def gold_answers(spark: SparkSession, root: str) -> DataFrame:
    """Gold answer per example; every third as lower case with a blank and a dot."""
    o = spread(table(spark, root, "orders").select("o_orderkey"))
    key = F.col("o_orderkey")
    L = F.substring(F.lit("ABCD"), (key % 4 + 1).cast("int"), 1)
    return o.select(key.alias("example_id"),
                    F.when(key % 3 == 0, F.concat(F.lit(" "), F.lower(L), F.lit(".")))
                     .otherwise(L).alias("answer"))


def preference_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Chosen/rejected log-probabilities with reference-model values and lengths."""
    d = spread(table(spark, root, "documents").select("doc_id", "source"))
    k = F.col("doc_id")
    return d.select(
        k.alias("pair_id"), "source",
        ((k * 7919) % 512).cast("double").alias("x1"),
        ((k * 104729 + 7) % 512).cast("double").alias("x2"),
        ((k * 31) % 512).cast("double").alias("x3"),
        ((k * 17 + 5) % 512).cast("double").alias("x4"),
        (k % 16 + 1).cast("int").alias("chosen_len"),
        (k % 9 + 1).cast("int").alias("rejected_len"),
    ).select("pair_id", "source",
             (F.col("x1") / -4).alias("chosen_logp"), (F.col("x2") / -4).alias("rejected_logp"),
             (F.col("x3") / -4).alias("ref_chosen_logp"), (F.col("x4") / -4).alias("ref_rejected_logp"),
             "chosen_len", "rejected_len")


def sft_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(prompt, target): each user turn and the assistant turn right after it.

    Equi-join on the unique (conv_id, turn) key, so a very long conversation
    cannot skew one task.
    """
    c = spread(table(spark, root, "conversations"))
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"], "inner")


def eval_questions(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation items (question, choices, answer) from the option-list source."""
    o = optlist_source(spark, root)
    return o.select(F.col("o_orderkey").alias("example_id"), "question",
                    F.transform("options", lambda x: x.substr(F.position(F.lit(")"), x) + 1,
                                                              F.lit(2**31 - 1))).alias("choices"),
                    F.col("correct").alias("answer"))


def passage_questions(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation items over whole documents: (example_id, prompt, continuations).

    Long texts pass the longest sequence; of the continuations one is empty and
    one grows into the prompt's last word.
    """
    d = spread(table(spark, root, "documents").select("doc_id", "text", "lang", "source"))
    conts = F.array(F.concat(F.lit(" "), F.col("source"), F.lit(" in "), F.col("lang")), F.lit(""),
                    F.concat(F.lit("-"), F.col("source")), F.concat(F.lit("\n"), F.col("lang"), F.lit(" <"), F.col("source"), F.lit(">")))
    return d.select(F.col("doc_id").alias("example_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nSource:")).alias("prompt"),
                    conts.alias("continuations"))


def vector_size(spark: SparkSession, root: str) -> int:
    return table(spark, root, "embeddings").agg(F.max(F.size("embedding"))).first()[0]


def with_logits(requests: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The positions of ``choice_requests`` with the logits of a stand-in model: a vector of ``embeddings``.

    The ids before a target, each times its place, add up to the vector's
    number, so the logits depend on the whole context; ids count modulo the
    vector's size. The sum over the prompt is made once per choice.
    """
    e = spread(table(spark, root, "embeddings").select("vec_id", "embedding"))
    n, size = e.count(), vector_size(spark, root)
    places = lambda ids, before: F.aggregate(F.transform(ids, lambda x, i: x.cast("long") * (i + before + 1)),
                                             F.lit(0).cast("long"), lambda a, b: a + b)
    p = requests.withColumn("base", places(F.slice("input_ids", F.lit(1), F.col("prompt_len")), F.lit(0))) \
        .withColumn("own", tk.choice_slice(F.col("input_ids"), F.col("prompt_len")))
    p = scored_positions(p, carry=("base", "own", "prompt_len"))
    place = F.col("base") + places(F.slice("own", F.lit(1), F.col("token_pos")), F.col("prompt_len"))
    p = p.select("example_id", "choice_idx", "token_pos", (F.col("target") % F.lit(size)).alias("target"), (place % F.lit(n)).alias("vec_id"))
    return p.join(e, "vec_id", "left").select("example_id", "choice_idx", "token_pos", "target", F.col("embedding").alias("logits"))
