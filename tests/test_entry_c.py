"""Entry point C from texts to accuracy: choice ids across the boundary, scores from logit sequences, the whole plan."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from sparqa.functions import tokens as tk
from sparqa.operators import evaluation as ev
from sparqa.plans import evaluation as plan
from sparqa.sources import fixtures



def _ids(text):
    """The default tokenizer, piece by piece."""
    out, at = [], 0
    blank = lambda c: c.isspace() and c != "\n"
    while at < len(text):
        if text.startswith("<|endoftext|>", at):
            end = at + 13
        elif text[at] == "\n":
            end = at + 1
        else:
            end = at
            while end < len(text) and blank(text[end]):
                end += 1
            word = end
            while word < len(text) and not text[word].isspace() and text[word] != "<":
                word += 1
            end = word if word > end else end + 1 if end < len(text) and text[end] == "<" else end
        piece = text[at:end]
        out.append(1 if piece == "<|endoftext|>" else int(hashlib.md5(piece.encode()).hexdigest()[:7], 16) + 2)
        at = end
    return out


PARTS = ["word", " ", "  ", "\n", "<", "<|endof", "text|>", "<|endoftext|>", "Answer:", "é", "\t", "|>", "x<y", "."]
CASES = [("Answer:", [" A", "A", "", "\n"]), ("a <|endof", ["text|>", "text", "text|> z"]), ("  ", ["a", " "]), ("", ["", "x y"]), ("q", []), ("q", [None, " a"])]


def test_choice_ids_over_any_boundary(spark):
    rng = random.Random(2)
    cases = CASES + [("".join(rng.choices(PARTS, k=rng.randrange(12))), ["".join(rng.choices(PARTS, k=rng.randrange(5))) for _ in range(4)]) for _ in range(150)]
    items = spark.createDataFrame([(i, p, c, 7) for i, (p, c) in enumerate(cases)] + [(999, None, ["a"], 1)],
                                  "example_id long, prompt string, continuations array<string>, prompt_len int")
    for max_len in (1024, 5, 1):
        got = {(r.example_id, r.choice_idx): (r.input_ids, r.prompt_len) for r in ev.choice_requests(items, max_len=max_len).collect()}
        assert got == {(i, k): (_ids(p + (c or ""))[:max_len], min(len(_ids(p)), max_len)) for i, (p, cs) in enumerate(cases) for k, c in enumerate(cs)}


def _softmax_at(vector, target):
    v = np.array(vector, float)
    return v[target] - (v.max() + math.log(np.exp(v - v.max()).sum()))


def test_sequence_logprob(spark):
    rng = np.random.default_rng(1)
    rows = [[[float(x) for x in rng.normal(size=6) * 30] for _ in range(n)] for n in (0, 1, 3, 3, 2, 1)]
    targets = [[], [5], [0, 1, 2], [0, 1], [3, 3], [6]]
    cases = list(zip(rows, targets)) + [(None, [1]), ([[1.0, 2.0]], None), (None, None)]
    df = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(cases)], "i int, v array<array<double>>, t array<int>")
    got = dict(map(tuple, df.select("i", tk.sequence_logprob("v", "t")).collect()))
    inf = float("-inf")
    for i, (r, t) in enumerate(cases[:5]):
        want = sum(_softmax_at(v, x) for v, x in zip(r, t)) if t and len(r) == len(t) else inf
        assert got[i] == pytest.approx(want, rel=1e-12)
    assert got[5] is None  # an id that the vector does not have
    assert [got[i] for i in (6, 7, 8)] == [inf] * 3


def test_shifted_rows_predict_the_ids_after_the_prompt(spark):
    logits = [[float(k)] for k in range(5)]
    df = spark.createDataFrame([(n, logits, [9] * 5) for n in (0, 1, 3, 5, 7)], "n int, v array<array<double>>, ids array<int>")
    got = dict(map(tuple, df.select("n", tk.shifted_rows("v", "ids", "n")).collect()))
    assert got == {0: [], 1: logits[0:4], 3: logits[2:4], 5: [], 7: []}


def test_loglik_is_put_together_in_order(spark):
    req = spark.createDataFrame([(1, 0, [4, 0, 1, 1], 1), (1, 1, [4], 1), (2, 0, [4, 0, 1], 1)], "example_id long, choice_idx int, input_ids array<int>, prompt_len int")
    pos = ev.scored_positions(req)
    assert [tuple(r) for r in pos.where("example_id = 1").orderBy("choice_idx", "token_pos").collect()] == [
        (1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 1), (1, 1, None, None)]
    vectors = {0: [1.0, 0.0], 1: [0.5, 2.0], 2: [0.0, 3.0]}
    rows = spark.createDataFrame([(1, 0, k, vectors[k]) for k in (2, 0, 1)] + [(2, 0, 1, vectors[1])], "example_id long, choice_idx int, token_pos int, logits array<double>")
    got = {(r.example_id, r.choice_idx): (r.n_targets, r.n_rows, r.loglik) for r in ev.choice_loglik(req, rows).collect()}
    want = _softmax_at(vectors[0], 0) + _softmax_at(vectors[1], 1) + _softmax_at(vectors[2], 1)
    assert got[1, 0][:2] == (3, 3) and got[1, 0][2] == pytest.approx(want)
    assert got[1, 1] == (0, 0, float("-inf")) and got[2, 0] == (2, 1, float("-inf"))


def test_a_choice_with_an_unscored_id_scores_minus_infinity(spark):
    toks = spark.createDataFrame([(1, 0, None), (1, 1, -3.0), (1, 1, -1.0), (1, 2, -0.5), (1, 2, None)], "example_id long, choice_idx int, logprob double")
    assert {r.choice_idx: r.score for r in ev.choice_scores(toks).collect()} == {0: float("-inf"), 1: -4.0, 2: float("-inf")}


ITEMS = [(1, " Which? ", ["red", " blue "], "b."), (2, "Long " * 40, ["x", "y", "z"], "C"), (3, "None", [], "A"), (4, "Q", ["u", "v"], "A")]


@pytest.mark.parametrize("max_len,want", [(1024, (4, 2, 2)), (20, (4, 1, 1)), (1, (4, 1, 1))])
def test_from_text_to_accuracy(spark, max_len, want):
    """The scorer prefers later letters; a prompt that fills the sequence leaves no choice ids, so the first letter wins (Q13)."""
    items = spark.createDataFrame(ITEMS, "example_id long, question string, choices array<string>, answer string")
    order = {_ids(f" {c}")[0]: k for k, c in enumerate("ABC")}
    mapping = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    got = plan.mcq_eval(items, lambda r: ev.scored_positions(r).withColumn("logprob", mapping[F.col("target")].cast("double")), max_len=max_len).first()
    assert (got.total, got.correct, got.correct_norm) == want


def test_eval_of_no_items(spark):
    items = spark.createDataFrame([], "example_id long, question string, choices array<string>, answer string")
    got = plan.mcq_eval(items, lambda r: ev.scored_positions(r).withColumn("logprob", F.lit(0.0))).first()
    assert (got.total, got.accuracy) == (0, 0.0)


def test_prompt_is_tokenised_once_per_example(spark):
    req = ev.choice_requests(fixtures.passage_questions(spark, SF_SMALL))
    text = req._jdf.queryExecution().optimizedPlan().toString()
    explode = text.index("Generate posexplode")
    assert "__text" in text[explode:] and text[:explode].count("regexp_extract_all") == 1  # above the explode only the rest is cut into pieces


def test_settled_pieces_without_a_walk(spark):
    """the first pieces are those of the text whatever is appended, and no aggregate over the prompt's pieces finds them."""
    rng = random.Random(8)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(14))) for _ in range(80)]
    df = spark.createDataFrame([(t, a) for t in texts for a in ("", "text|>", "x", "\n")], "t string, a string")
    got = df.select("t", "a", tk.settled_pieces("t").alias("s"), tk.pieces(F.concat("t", "a")).alias("p")).collect()
    assert all(r.s.pieces == r.p[:len(r.s.pieces)] and r.s.chars == sum(map(len, r.s.pieces)) <= len(r.t) for r in got)
    req = ev.choice_requests(df.selectExpr("1L AS example_id", "t AS prompt", "array(a) AS continuations"))
    assert "aggregate(" not in req._jdf.queryExecution().optimizedPlan().toString()
