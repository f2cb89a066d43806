import random

from pyspark.sql import functions as F

from sparqa.functions import formatting as fmt

EOS = "<eos>"
Q = "Pick\nA: red\nB: blue\nC: tan\nD: grey"

GOLDEN = [
    ((Q, "B: blue", None), ("Pick\nA. red\nB. blue\nC. tan\nD. grey\nAnswer: B<eos>", 42)),
    ((Q, "B. blue", "  why "), ("Pick\nA. red\nB. blue\nC. tan\nD. grey\nAnswer: B\nReasoning: why<eos>", 42)),
    (("What is 2+2?", "4", ""), ("What is 2+2?\n\nAnswer: 4<eos>", 21)),
    (("Pick\nA: x\nB: y", "b.", ""), ("Pick\nA. x\nB. y\nAnswer: B<eos>", 22)),
    (("Pick\nA: red\nand more\nB: blue", "A", ""), ("Pick\nA. red\nB. blue\nAnswer: A<eos>", 27)),
    (("In DNA: x?\nB: y", "B", ""), ("In DN\nA. x?\nB. y\nAnswer: B<eos>", 24)),
    (("Pick\nA:\nB: blue\nC: tan", "C", ""), ("Pick\nA. B: blue\nC. tan\nAnswer: C<eos>", 30)),
    (("Pick\nA: x", "None", ""), ("Pick\nA. x\nAnswer: N<eos>", 17)),
]


def _run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, q string, a string, r string")
    out = df.select("i", fmt.format_with_rationale("q", "a", "r", EOS).alias("f")).collect()
    return [(x.f.text, x.f.prompt_length_chars) for x in sorted(out, key=lambda x: x.i)]


def test_golden(spark):
    assert _run(spark, [g[0] for g in GOLDEN]) == [g[1] for g in GOLDEN]


PIECES = ["A:", "B:", "C:", "D:", "E:", "F:", "\n", " ", "  ", "x", "Y", "and", "3", "٣",
          ".", "\t", "\xa0", "é", "\n\n", "DNA:"]


def test_properties_of_random_rows(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(2000):
        q = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        rows.append((q, rng.choice(["A", "b.", " c ", "None", "4", "e.", "d", "Ab", "é."]), rng.choice([None, "", "  ", "because\n", " x y "])))
    for (_, _, reasoning), (text, length) in zip(rows, _run(spark, rows)):
        prompt, response = text[:length], text[length:]
        assert prompt.endswith("\nAnswer:") and response.startswith(" ") and response.endswith(EOS)
        assert ("\nReasoning: " in response) == bool((reasoning or "").strip())
        assert (reasoning or "").strip() in response


def test_answer_only(spark):
    df = spark.createDataFrame([("Q?", "A: x")], "q string, a string")
    r = df.select(fmt.format_answer_only("q", "a").alias("f")).first().f
    assert (r.text, r.prompt_length_chars) == ("Q?\nA: x", 3)


def test_eval_prompt_and_gold(spark):
    choices = [f"c{i} " for i in range(30)]
    df = spark.createDataFrame([(" What? ", choices, " b. ")], "q string, c array<string>, a string")
    r = df.select(fmt.eval_prompt("q", "c", "topic").alias("p"), fmt.eval_continuations("c").alias("k"),
                  fmt.eval_gold("a").alias("g")).first()
    assert r.p.startswith("The following are multiple choice questions (with answers) about topic.\n\nWhat?\nA. c0\n")
    assert r.p.endswith("Z. c25\nAnswer:")
    assert len(r.k) == 26 and r.k[0] == " A" and r.k[-1] == " Z"
    assert r.g == "B"


def test_chat_render(spark):
    df = spark.createDataFrame([("hi", "yo")], "p string, t string")
    text = df.select(fmt.render_chat([("user", F.col("p")), ("assistant", F.col("t"))])).first()[0]
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"


def test_anchored_option(spark):
    df = spark.createDataFrame([("In DNA: x?\nB: y", "B", "")], "q string, a string, r string")
    r = df.select(fmt.format_with_rationale("q", "a", "r", EOS, anchored=True).alias("f")).first().f
    assert r.text == "In DNA: x?\nB. y\nAnswer: B<eos>"


def test_gold_letter_option(spark):
    df = spark.createDataFrame([("A: red",), (" b. ",)], "a string")
    got = [r.g for r in df.select(fmt.eval_gold("a", mode="letter").alias("g")).collect()]
    assert got == ["A", "B"]
