import pytest

from sparqa.operators import evaluation as ev

CASES = [  # gold, scores -> pred, normalised gold, exact, stripped
    ("a.", [-1.0, -1.0], ("A", "A", True, True)),
    ("B", [float("-inf"), float("-inf")], ("A", "B", False, False)),
    ("A .", [-1.0, -2.0], ("A", "A ", False, True)),
    ("A: red", [-1.0, -2.0], ("A", "A: RED", False, False)),
    ("A", [], ("NONE", "A", False, False)),
]


def test_predictions_golden(spark):
    scores = spark.createDataFrame(
        [(i, j, s) for i, (_, sc, _) in enumerate(CASES) for j, s in enumerate(sc)],
        "example_id long, choice_idx int, score double")
    gold = spark.createDataFrame([(i, g) for i, (g, _, _) in enumerate(CASES)], "example_id long, answer string")
    got = {r.example_id: (r.pred, r.gold, r.correct, r.correct_norm)
           for r in ev.predictions(scores, gold).collect()}
    assert got == {i: c[2] for i, c in enumerate(CASES)}
    acc = ev.accuracy(ev.predictions(scores, gold)).first()
    assert acc.total == 5 and acc.correct == 1 and acc.correct_norm == 2
    assert acc.accuracy_norm >= acc.accuracy


def test_empty_accuracy_is_zero(spark):
    empty = spark.createDataFrame([], "example_id long, pred string, gold string, correct boolean, correct_norm boolean")
    r = ev.accuracy(empty).first()
    assert r.total == 0 and r.accuracy == 0.0


def test_missing_choice_scores_minus_infinity(spark):
    toks = spark.createDataFrame([(1, 1, 0, -0.5)], "example_id long, choice_idx int, token_pos int, logprob double")
    choices = spark.createDataFrame([(1, 0), (1, 1)], "example_id long, choice_idx int")
    got = {r.choice_idx: r.score for r in ev.choice_scores(toks, choices).collect()}
    assert got == {0: float("-inf"), 1: -0.5}


def test_preference_modes(spark):
    pairs = spark.createDataFrame([(1, "s", -1.0, -2.0, -3.0, -1.0, 1, 4)],
                                  "pair_id long, source string, chosen_logp double, rejected_logp double, "
                                  "ref_chosen_logp double, ref_rejected_logp double, chosen_len int, rejected_len int")
    got = {r.mode: r.accuracy for r in ev.preference_accuracy(pairs).collect()}
    assert got == {"sum": 1.0, "avg": 0.0, "none": 1.0}
    with pytest.raises(ValueError):
        ev.preference_accuracy(pairs, modes=("norm",))


def test_evaluate_plan_and_requests(spark):
    from conftest import SF_SMALL
    from sparqa.plans import evaluation as plan
    from sparqa.sources import fixtures
    acc = plan.evaluate(fixtures.token_logprobs(spark, SF_SMALL), fixtures.gold_answers(spark, SF_SMALL)).first()
    assert acc.total > 0 and 0.0 <= acc.accuracy <= acc.accuracy_norm <= 1.0
    req = plan.eval_requests(fixtures.eval_questions(spark, SF_SMALL))
    r = req.where("choice_idx = 4").first()
    assert r.continuation == " E" and r.prompt.endswith("Answer:")


def test_avg_normalisation_changes_the_winner(spark):
    # Q16: summed scores favour short choices; per-token averages do not
    toks = spark.createDataFrame([(1, 0, 0, -2.0), (1, 1, 0, -1.5), (1, 1, 1, -1.5), (1, 1, 2, -1.5)],
                                 "example_id long, choice_idx int, token_pos int, logprob double")
    gold = spark.createDataFrame([(1, "B")], "example_id long, answer string")
    by_sum = ev.predictions(ev.choice_scores(toks), gold).first()
    by_avg = ev.predictions(ev.choice_scores(toks, normalise="avg"), gold).first()
    assert (by_sum.pred, by_avg.pred) == ("A", "B") and by_avg.correct
