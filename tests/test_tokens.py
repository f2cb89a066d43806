from pyspark.sql import functions as F

from sparqa.functions import tokens as tk
from sparqa.operators import tokenise

TEXTS = ["Pick\nA. red\nAnswer: B<|endoftext|>", "  lead <x> a<b\n\n tail  ", "", "<|endoftext|>",
         "é ü\t\x0bword x"]


def test_pieces_tile_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", tk.pieces("t").alias("p")).collect():
        assert "".join(r.p) == r.t
        assert all(p for p in r.p)


def test_eos_piece_and_ids(spark):
    df = spark.createDataFrame([("A B<|endoftext|>",)], "t string")
    r = df.select(tk.pieces("t").alias("p"), tk.token_ids("t", 10).alias("i")).first()
    assert r.p == ["A", " B", "<|endoftext|>"]
    assert r.i[-1] == tk.EOS_ID and all(x >= 2 for x in r.i[:-1])


def test_masking_and_boundary(spark):
    rows = [("Q one two\nAnswer: A<|endoftext|>", len("Q one two\nAnswer:")),
            ("a b c d e f g h i j", 15)]
    df = spark.createDataFrame(rows, "text string, prompt_length_chars int")
    out = tokenise.tokenise(df, max_len=4).collect()
    # first row: prompt has more pieces than the truncation keeps -> boundary lost, nothing masked but pad
    r0 = out[0]
    assert r0.n_tokens == 4 and r0.boundary_lost and r0.response_start == 0
    assert r0.labels == r0.input_ids
    full = tokenise.tokenise(df, max_len=64).collect()[0]
    assert not full.boundary_lost
    starts, acc = [], 0
    for p in spark.createDataFrame([rows[0]], "text string, p int").select(tk.pieces("text")).first()[0]:
        starts.append(acc)
        acc += len(p)
    first = next(i for i, s in enumerate(starts) if s >= rows[0][1])
    assert full.response_start == first
    assert full.labels[:first] == [-100] * first
    assert full.labels[-1] == -100          # end-of-sequence id doubles as pad id
    assert len(full.labels) == len(full.input_ids) == full.n_tokens


def test_padding(spark):
    df = spark.createDataFrame([("x y", 1)], "text string, prompt_length_chars int")
    r = tokenise.tokenise(df, max_len=6, pad=True).first()
    assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 6
    assert r.attention_mask == [1, 1, 0, 0, 0, 0]
    assert r.labels[2:] == [-100] * 4


def test_label_filter_counts(spark):
    from pyspark.sql import Observation
    df = spark.createDataFrame([([1, 2], [-100, 2]), ([3], [-100])], "input_ids array<int>, labels array<int>")
    obs = Observation("f")
    kept = tokenise.label_filter(df, observation=obs).collect()
    assert len(kept) == 1 and obs.get["rows_removed"] == 1


def test_log_softmax(spark):
    import math
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "v array<float>, t int")
    got = df.select(tk.log_softmax_at("v", F.col("t"))).first()[0]
    want = 3.0 - math.log(math.exp(1) + math.exp(2) + math.exp(3))
    assert abs(got - want) < 1e-12


def test_drop_boundary_lost_option(spark):
    df = spark.createDataFrame([([1], [5], True), ([2], [6], False)],
                               "input_ids array<int>, labels array<int>, boundary_lost boolean")
    assert tokenise.label_filter(df).count() == 2
    assert tokenise.label_filter(df, drop_boundary_lost=True).count() == 1


def test_external_tokenizer_path_matches_jvm_path(spark):
    # defined inside the test so it is shipped to the Python workers by value
    def _python_piece_encoder():
        """The default piece tokenizer restated with Python's re (for the
        external-tokenizer path): returns ids and start offsets."""
        import hashlib
        import re

        from sparqa.functions.text import WS_CHARS
        ws = "".join(WS_CHARS)
        blank = "[" + re.escape(ws.replace("\n", "")) + "]"
        word = "[^" + re.escape(ws) + "<]"
        pat = re.compile(re.escape("<|endoftext|>") + r"|\n|" + blank + "*" + word + "+|" + blank + "*<|" + blank + "+")

        def encode(texts):
            out = []
            for t in texts:
                ids, starts = [], []
                for m in pat.finditer(t):
                    p = m.group(0)
                    ids.append(1 if p == "<|endoftext|>" else int(hashlib.md5(p.encode()).hexdigest()[:7], 16) + 2)
                    starts.append(m.start())
                out.append((ids, starts))
            return out
        return encode

    rows = [("Q one two\nAnswer: A<|endoftext|>", 17), ("x  y\tz <a> é", 3), ("", 0),
            ("p " * 40 + "\nAnswer: B<|endoftext|>", 30)]
    df = spark.createDataFrame(rows, "text string, prompt_length_chars int")
    jvm = {r.text: (r.input_ids, r.response_start, r.labels, r.boundary_lost)
           for r in tokenise.tokenise(df, max_len=16).collect()}
    ext = {r.text: (r.input_ids, r.response_start, r.labels, r.boundary_lost)
           for r in tokenise.tokenise_with(df, _python_piece_encoder, max_len=16, pad_id=1).collect()}
    assert jvm == ext


def test_choice_slice(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 2), ([5], 3)], "ids array<int>, n int")
    got = [r.s for r in df.select(tk.choice_slice(F.col("ids"), F.col("n")).alias("s")).collect()]
    assert got == [[7, 8], []]


def test_hf_tokenizer_path(spark):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit

    vocab = {"[PAD]": 0, "[UNK]": 1, "Q": 2, "one": 3, "two": 4, "Answer:": 5, "A": 6}
    tok = Tokenizer(WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = WhitespaceSplit()
    df = spark.createDataFrame([("Q one two\nAnswer: A", len("Q one two\nAnswer:")), ("Q zzz", 1)],
                               "text string, prompt_length_chars int")
    make = tokenise.hf_encoder(spark, tok.to_str())
    rows = {r.text: r for r in tokenise.tokenise_with(df, make, max_len=8, pad_id=0).collect()}
    r = rows["Q one two\nAnswer: A"]
    assert r.input_ids == [2, 3, 4, 5, 6] and r.response_start == 4
    assert r.labels == [-100, -100, -100, -100, 6] and not r.boundary_lost
    assert rows["Q zzz"].input_ids == [2, 1] and rows["Q zzz"].response_start == 1


def test_padded_checksums_are_those_of_the_joined_lists(spark):
    """Lists reach the checksum without a string for each of their numbers."""
    from conftest import SF_SMALL
    from sparqa.operators import tokenise
    from sparqa.plans import queries
    got = queries.tokenise_padded(spark, SF_SMALL)
    assert got._jdf.queryExecution().analyzed().toString().count("to_json") == 3
    lists = tokenise.tokenise(queries.format_rationale(spark, SF_SMALL), tokenise.MAX_LEN_RATIONALE, pad=True)
    joined = lists.selectExpr("row_id", *(f"md5(array_join({c}, ',')) AS {c}" for c in ("input_ids", "attention_mask", "labels")))
    assert got.select(joined.columns).exceptAll(joined).count() == 0


def test_pieces_before_any_limit(spark):
    """Pieces that start before the prompt's end, wherever it lies, also inside an end-of-sequence text."""
    import random
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n", "<", "<|endof", "text|>", "<|endoftext|>", "é", "\t", "|>", "x<y", "\U0001f600"]
    rows = [("".join(rng.choices(parts, k=rng.randrange(9))), n) for _ in range(60) for n in (None, -2, *range(0, 30, rng.randrange(1, 4)))]
    df = spark.createDataFrame(rows + [(None, 3)], "text string, n int").withColumn("p", tk.pieces("text"))
    for kept in (F.col("p"), F.slice("p", 1, 3)):
        walked = F.coalesce(tk.starts_before(kept, F.col("n")), F.lit(0))
        assert df.where(~tk.pieces_before("text", kept, F.col("n")).eqNullSafe(walked)).collect() == []


def test_prompt_end_is_found_without_a_walk_over_every_piece(spark):
    """The walk is a last resort of the one plan, the newline needs no md5."""
    df = spark.createDataFrame([("a\nb", 2)], "text string, prompt_length_chars int")
    plan = tokenise.tokenise(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "least(size(regexp_extract_all(substr(" in plan
    assert tokenise.tokenise(df).first().input_ids[1] == df.select((F.conv(F.substring(F.md5(F.lit("\n")), 1, 7), 16, 10).cast("int") + 2)).first()[0]


def test_option_list_is_taken_apart_once(spark):
    """Text and answer of an option list come from one pass over its options."""
    from sparqa.operators import curate
    df = spark.createDataFrame([(1, "q", ["A) 1", " B)f(2)", "B)x"], "r", "B"), (2, "q", ["A)1"], None, "Z")],
                               "o_orderkey long, question string, options array<string>, rationale string, correct string")
    got = curate.curate_optlist(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("substring_index(") == 1
    assert [(r.question, r.answer) for r in got.orderBy("row_id").collect()] == [("q\nA: 1\nB: f(2)\nB: x", "B: f(2)"), ("q\nA: 1", "Z")]
