import random

from sparqa.functions.answers import extract_answer

Q = "Pick\nA: red\nB: blue\nC: tan\nD: grey"

GOLDEN = [
    (r"so $\boxed{\text{B}}$", Q, "B. blue"),
    (r"\boxed{42}", Q, None),
    (r"\boxed{{x{y}}} or \boxed{C}", Q, "C. tan"),
    ("steps\nconclusion: C", Q, "C. tan"),
    ("Conclusion - the Answer is B", Q, None),
    ("one\nD is left\nso $\\blacksquare$", Q, "D. grey"),
    ("no answer", Q, None),
    (r"\boxed{} Conclusion: A", Q, None),
    (r"\boxed{A}", "DNA: what?\nA: red", "A. what?"),
    (r"\boxed{A}", "Pick\nA:\nB: blue", "A. B: blue"),
    (r"\boxed{D}", "Pick\nA: red", None),
]


def _run(spark, pairs):
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(pairs)], "i int, s string, q string")
    rows = df.select("i", extract_answer("s", "q").alias("a")).collect()
    return [r.a for r in sorted(rows, key=lambda r: r.i)]


def test_golden(spark):
    got = _run(spark, [(s, q) for s, q, _ in GOLDEN])
    assert got == [e for _, _, e in GOLDEN]


PIECES = ["\\boxed{", "}", "{", "$", "Conclusion", "conclusion:", "CONCLUSION-", " - ", "\n", "\r\n",
          "A", "B", "C", "D", "E", "x", "y", " ", "  ", "\t", ":", "é", " ", "\x0b", "\x1c",
          "\xa0", "$\\blacksquare$", "the Answer is ", "42"]


def _rand_text(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, n)))


def _rand_question(rng):
    parts = [_rand_text(rng, 4)]
    for L in rng.sample("ABCDE", rng.randint(0, 5)):
        parts.append(f"{L}:{rng.choice(['', ' ', '  ', chr(10)])}{_rand_text(rng, 3)}")
    return "\n".join(parts)


def test_properties_of_random_texts(spark):
    rng = random.Random(7)
    pairs = [(_rand_text(rng, 12), _rand_question(rng)) for _ in range(3000)]
    kept = [(p, a) for p, a in zip(pairs, _run(spark, pairs)) if a is not None]
    assert len(kept) > 100
    for (_, question), answer in kept:
        key, option = answer.split(". ", 1)
        assert set(key) <= set("ABCD") and key and f"{key}:" in question and option in question


def test_deep_box_does_not_overflow(spark):
    big = "\\boxed{" + ("ab" * 20000) + "A}"
    assert _run(spark, [(big, "A: ok")]) == ["A. ok"]


def test_strict_letter_option(spark):
    df = spark.createDataFrame([("Conclusion - the Answer is B", Q), (r"\boxed{(C)}", Q), (r"\boxed{C.}", Q)],
                               "s string, q string")
    got = [r.a for r in df.select(extract_answer("s", "q", strict_letter=True).alias("a")).collect()]
    assert got == [None, "C. tan", "C. tan"]
