import sys

from pyspark.sql import functions as F

from sparqa.functions import text as tx
from sparqa.functions import tokens as tk


def _all_code_points(spark):
    cps = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    return spark.createDataFrame([(c, chr(c)) for c in cps], "cp int, ch string")


def test_java_classes_equal_python_whitespace(spark):
    df = _all_code_points(spark)
    got = df.select("cp", F.col("ch").rlike("^" + tx.WS_J + "$").alias("ws"),
                    F.col("ch").rlike("^" + tx.BLANK_J + "$").alias("blank"),
                    F.col("ch").rlike("^" + tx.NOT_WS_J + "$").alias("notws"),
                    F.col("ch").rlike("^" + tx.WS + "$").alias("portable"))
    bad = got.where((F.col("ws") != F.col("portable")) | (F.col("notws") == F.col("ws"))
                    | (F.col("blank") != (F.col("ws") & (F.col("cp") != 10)))).collect()
    assert not bad, bad[:5]
    ws = {r.cp for r in got.where("ws").collect()}
    assert ws == {ord(c) for c in tx.WS_CHARS}


def test_piece_patterns_agree(spark):
    texts = ["a b c\x1cd\x85e　f  <x> <|endoftext|>\n\n\t z", "é ü x "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(F.regexp_extract_all("t", F.lit(tk.piece_pattern(java=True)), 0).alias("j"),
                  F.regexp_extract_all("t", F.lit(tk.piece_pattern()), 0).alias("p")).collect()
    assert all(x.j == x.p for x in r)


def test_strip_and_splitlines(spark):
    s = " \t　a b\x1c\n"
    df = spark.createDataFrame([(s, "a\r\nb\x0bc d\n")], "s string, l string")
    r = df.select(tx.strip("s").alias("s"), tx.splitlines("l").alias("l")).first()
    assert r.s == s.strip() and r.l == "a\r\nb\x0bc d\n".splitlines()
