from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparqa.operators import curate


def test_distractor_equal_to_answer_takes_last_label(spark):
    df = spark.createDataFrame([(1, "Q?", "7", "7", "7", "7", "s")],
                               "p_partkey long, question string, distractor1 string, distractor2 string, "
                               "distractor3 string, correct_answer string, support string")
    r = curate.curate_distractor(df).first()
    assert r.answer == "D: 7"                       # every option equals the answer -> last letter
    assert r.question == "Q?\nA: 7\nB: 7\nC: 7\nD: 7" and r.source == "SciQ" and r.row_id == 5


def test_distractor_rendering_and_seed(spark):
    df = spark.createDataFrame([(k, "Q", "a", "b", None, "c", "") for k in range(50)],
                               "p_partkey long, question string, distractor1 string, distractor2 string, "
                               "distractor3 string, correct_answer string, support string")
    rows = curate.curate_distractor(df).collect()
    for r in rows:
        lines = r.question.split("\n")[1:]
        assert sorted(x[3:] for x in lines) == ["None", "a", "b", "c"]   # null renders as None
        letter = r.answer[0]
        assert f"{letter}: c" in lines and r.answer == f"{letter}: c"
    assert len({r.question for r in rows}) > 1          # the seeded order varies by row
    again = curate.curate_distractor(df).collect()
    assert {r.row_id: r.question for r in rows} == {r.row_id: r.question for r in again}


def test_optlist_reformat_unmatched_and_rejects(spark):
    df = spark.createDataFrame([(1, "Q", ["A) x ", "B)f(2)", "C)"], "B", "r"),
                                (2, "Q", ["A)1", "B)2"], "E", "r"),
                                (3, "Q", ["A)1", "no paren"], "A", "r")],
                               "o_orderkey long, question string, options array<string>, correct string, "
                               "rationale string")
    obs = Observation("o")
    got = {r.row_id: (r.question, r.answer) for r in curate.curate_optlist(df, observation=obs).collect()}
    assert got == {6: ("Q\nA: x\nB: f(2)\nC: ", "B: f(2)"), 10: ("Q\nA: 1\nB: 2", "E")}
    assert obs.get["rows_removed"] == 1


def test_fourcol_filters_index_and_nulls(spark):
    rows = [(1, "Q", "a", "b", "c", "d", 2, "e", "single"),
            (2, "Q", "a", "b", "c", "d", 5, "e", "single"),      # index out of range -> rejected
            (3, "Q", "a", None, "c", "d", 1, "e", "single"),     # chosen option null -> rejected
            (4, "Q", "a", None, "c", "d", 0, "e", "single"),     # other option null -> "None"
            (5, "Q", "a", "b", "c", "d", 0, None, "single"),     # no explanation (F1)
            (6, "Q", "a", "b", "c", "d", 0, "e", "multi")]       # not single (F2)
    df = spark.createDataFrame(rows, "c_custkey long, question string, opa string, opb string, opc string, "
                                     "opd string, cop int, exp string, choice_type string")
    obs = Observation("f")
    got = {r.row_id: (r.question, r.answer) for r in curate.curate_fourcol(df, observation=obs).collect()}
    assert got == {7: ("Q\nA: a\nB: b\nC: c\nD: d", "C: c"), 19: ("Q\nA: a\nB: None\nC: c\nD: d", "A: a")}
    assert obs.get["rows_removed"] == 2


def test_boxed_counts_removed(spark):
    df = spark.createDataFrame([(1, "A: x", r"\boxed{A}", "s"), (2, "A: x", "none", "s"),
                                (3, None, r"\boxed{A}", "s")],
                               "doc_id long, problem string, solution string, source string")
    obs = Observation("b")
    got = [(r.row_id, r.answer) for r in curate.curate_boxed(df, observation=obs).collect()]
    assert got == [(4, "A. x")] and obs.get["rows_removed"] == 2
