"""Counts per stage (A7), and outcomes that agree with what the curators keep."""

from sparqa.functions import tokens as tk
from sparqa.operators import curate, profile, tokenise


def outcomes(df, kind):
    return [r.outcome for r in curate.outcome(df, kind).collect()]


def test_outcomes_agree_with_the_curators(spark):
    b = "So \\boxed{B}"
    boxed = spark.createDataFrame([(1, "q\nA: x\nB: y", b, "s"), (2, None, b, "s"), (3, "q", None, None), (4, "q", "nothing", "s")],
                                  "doc_id long, problem string, solution string, source string")
    assert sorted(outcomes(boxed, "boxed")) == ["kept", "no_answer", "null_input", "null_input"]
    distr = spark.createDataFrame([(1, "q", "a", "b", "c", "d", "s"), (2, None, "a", "b", "c", "d", "s"), (3, "q", "a", "b", None, None, "s")],
                                  "p_partkey long, question string, distractor1 string, distractor2 string, distractor3 string, correct_answer string, support string")
    assert sorted(outcomes(distr, "distractor")) == ["kept", "null_input", "null_input"]
    optl = spark.createDataFrame([(1, "q", ["A)1"], "r", "A"), (2, "q", ["A 1"], "r", "A"), (3, "q", None, "r", "A"), (4, "q", ["A)1", None], "r", "A")],
                                 "o_orderkey long, question string, options array<string>, rationale string, correct string")
    assert sorted(outcomes(optl, "optlist")) == ["kept", "malformed_options", "malformed_options", "null_input"]
    four = spark.createDataFrame([(1, "q", "a", "b", "c", "d", 0, "e", "single"), (2, "q", "a", "b", "c", "d", 9, "e", "single"),
                                  (3, "q", "a", "b", "c", "d", 0, None, "single"), (4, "q", "a", "b", "c", "d", 0, "e", None),
                                  (5, None, "a", "b", "c", "d", 0, "e", "single")],
                                 "c_custkey long, question string, opa string, opb string, opc string, opd string, cop int, exp string, choice_type string")
    assert sorted(outcomes(four, "fourcol")) == ["kept", "no_answer", "no_explanation", "not_single", "null_input"]
    for df, kind in ((boxed, "boxed"), (distr, "distractor"), (optl, "optlist"), (four, "fourcol")):
        assert getattr(curate, f"curate_{kind}")(df).count() == outcomes(df, kind).count("kept")


def test_levels_add_up(spark):
    rows = [("a", "train", "s", "kept")] * 3 + [("a", "train", None, "bad")] * 2 + [("a", "test", "s", "worse"), ("b", None, "s", None)]
    df = spark.createDataFrame(rows, "stage string, split string, source string, outcome string")
    got = {(r.level, r.stage, r.split, r.source, r.outcome): (r.rows_in, r.rows_kept, r.rows_removed) for r in profile.stage_counts(df).collect()}
    assert got[(1, "a", None, None, None)] == (6, 3, 3)
    assert got[(2, "a", "train", None, None)] == (5, 3, 2)
    assert got[(3, "a", "train", None, None)] == (2, 0, 2)     # a source that is null
    assert got[(4, "a", "train", None, "bad")] == (2, 0, 2)
    assert got[(4, "b", None, "s", None)] == (1, 0, 1)
    assert sum(v[0] for k, v in got.items() if k[0] == 4) == len(rows)
    assert profile.stage_counts(df.where("false")).count() == 0


def test_padded_rows(spark):
    df = spark.createDataFrame([(1, "one two three four", 7), (2, "a", 0), (3, "", 0), (4, None, 0)], "row_id long, text string, prompt_length_chars int")
    got = {r.row_id: r for r in tokenise.tokenise(df, 3, pad=True).collect()}
    for i in (1, 2, 3):
        r = got[i]
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 3
        assert sum(r.attention_mask) == r.n_tokens == min(3, r.n_tokens)
        assert r.input_ids[r.n_tokens:] == [tk.EOS_ID] * (3 - r.n_tokens) and set(r.labels[r.n_tokens:]) <= {tk.IGNORE}
    assert got[1].n_tokens == 3 and got[2].attention_mask == [1, 0, 0] and got[3].attention_mask == [0, 0, 0]
