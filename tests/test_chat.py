"""Multi-turn chat rendering against a rendering in Python, message by message."""

import random

from sparqa.operators import chat, sampling

SCHEMA = "conv_id long, turn long, role string, text string, message string"
HEAD, TAIL = "<|im_start|>{}\n", "<|im_end|>\n"


def rendered(rows):
    """Conversation -> its text; turns of one role in a row are one message."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", len(r[3] or "")))
        messages = []
        for _, _, role, text, _ in mine:
            if messages and messages[-1][0] == (role or ""):
                messages[-1][1].append(text or "")
            else:
                messages.append((role or "", [text or ""]))
        out[conv] = ("".join(HEAD.format(r) + chat.JOINT.join(t) + TAIL for r, t in messages), len(messages))
    return out


def check(spark, rows, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)  # a column of the input is called like one of the result
    got = chat.conversation_fragments(df if parts is None else df.repartition(parts)).collect()
    assert len(got) == len(rows)
    for conv, (text, messages) in rendered(rows).items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.char_start)
        assert "".join(r.fragment for r in mine) == text
        at = 0
        for r in mine:
            assert r.char_start == at and r.n_chars == len(r.fragment)
            at += r.n_chars
        assert [mine[0].message, mine[-1].message] == [0, messages - 1]


def test_every_turn_of_every_role(spark):
    check(spark, [(1, 0, "system", "be brief", "x"), (1, 1, "user", "hé 🦆", None), (1, 2, "user", "and?", None),
                  (1, 3, "assistant", "", None), (2, 0, "assistant", "first", None), (2, 5, "user", "unanswered", None)])


def test_nulls_and_repeats(spark):
    check(spark, [(None, None, None, None, None), (None, 1, "user", "a", None), (None, 1, "user", "a", None),
                  (3, None, "tool", None, None), (3, 0, None, "x", None), (3, 0, "", "yy", None)])


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 25)   # a long conversation is cut into many ranges
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "tool"]), "w" * rng.randrange(40), None) for i in range(700)]
    rows += [(c, t, rng.choice(["user", "assistant"]), "t" * rng.randrange(9), None) for c in range(20, 60) for t in range(rng.randrange(1, 6))]
    check(spark, rows, 6)
    placed = sampling.in_order(spark.createDataFrame(rows, SCHEMA), ("conv_id",), ["turn"], "test")
    sizes = [r["count"] for r in placed.groupBy(sampling.partition_of()).count().collect()]
    assert max(sizes) < 150


def test_no_turns_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.conversation_fragments(df)
    assert out.count() == 0
    assert out.columns == ["conv_id", "turn", "role", "message", "char_start", "n_chars", "fragment"]
    # texts move twice at any size: into ranges before, then once for all windows and joins
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = chat.conversation_fragments(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, scan, _ = wide.partition("FileScan")   # the first scan is the one that reads texts
    assert "text#" in wide[len(above):].splitlines()[0] and scan
    assert above.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in above
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastNestedLoop" not in plan
