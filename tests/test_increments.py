"""Mergeable length profiles, the cut of the first chunks, and the build-once protocol."""

import random
import threading

import pytest

from sparqa.operators import profile, retrieval, sampling
from sparqa.sources.sinks import materialise_once, options_key, published


# ---------------------------------------------------------- length state

def test_merged_states_equal_a_rebuild_within_the_bound(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), rng.choice(["train", "test"]), "x" * int(10 ** rng.uniform(0, 4.3))) for _ in range(600)]
    rows += [("c", "train", None), ("c", "train", ""), ("d", "test", None), (None, "test", "y" * 300)]
    df = spark.createDataFrame(rows, "source string, split string, text string")
    third = [df.where(f"length(coalesce(text, '')) % 3 = {i}") for i in range(3)]
    merged = profile.merge_states(profile.merge_states(*(profile.length_state(p) for p in third[:2])), profile.length_state(third[2]))
    assert sorted(map(str, merged.collect())) == sorted(map(str, profile.length_state(df).collect()))
    exact = {r.source: r for r in profile.length_profile(df, by="source").where("source is not null").collect()}
    got = {r.source: r for r in profile.profile_of_state(merged, "source").collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got[None].max_len == 300
    for s, e in exact.items():
        g = got[s]
        assert (g.rows, g.max_len) == (e.rows, e.max_len)
        for have, want in ((g.median_len, e.median_len), (g.p90_len, e.p90_len)):
            assert have == want or (want is not None and want * (1 - 2 / profile.EXACT_BELOW) - 1 <= have <= want)
    assert got["c"].median_len == 0 and got["d"].median_len is None
    assert merged.count() < len(rows)
    both = profile.profile_of_state(merged).first()
    assert both.rows == len(rows)
    assert profile.profile_of_state(profile.length_state(df.where("false")), "source").count() == 0


# ------------------------------------------------------------------- J6

def first_chunks(rows, size, n):
    out = []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").split()
        out += [(i, k, " ".join(words[k * size:(k + 1) * size])) for k in range((len(words) + size - 1) // size)]
    return out[:n]


@pytest.mark.parametrize("bucket_rows", [10, 250_000])
def test_first_chunks_at_every_cut(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 0, 0, 1, 5, 30]))) for i in rng.sample(range(1000), 60)] + [(None, "n u l l"), (2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    total = len(first_chunks(rows, 3, 10 ** 9))
    for n in (1, 2, 3, 17, total - 1, total, total + 5):
        got = [(r.doc_id, r.chunk_idx, r.text) for r in retrieval.chunk_documents(df, chunk_tokens=3, max_chunks=n).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(got, key=key) == first_chunks(rows, 3, n)


def test_first_chunks_of_nothing_and_plan(spark):
    df = spark.createDataFrame([(1, " "), (2, None)], "doc_id long, text string")
    assert retrieval.chunk_documents(df, max_chunks=3).count() == 0
    assert retrieval.chunk_documents(df.where("false"), max_chunks=3).count() == 0
    many = spark.range(50).selectExpr("id as doc_id", "repeat('w ', 20) as text")
    plan = retrieval.chunk_documents(many, chunk_tokens=4, max_chunks=33)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


# ------------------------------------------------------------------- S5

def test_two_builders_at_once_agree(spark, tmp_path):
    meet, got = threading.Barrier(2, timeout=60), []

    def build(n):
        def rows():
            meet.wait()
            return spark.range(n)
        return rows

    def run(n):
        got.append(materialise_once(spark, str(tmp_path), build(n), {"v": 1}).count())

    threads = [threading.Thread(target=run, args=(n,)) for n in (3, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 2 and set(got) <= {3, 9}
    later = {materialise_once(spark, str(tmp_path), lambda: 1 / 0, {"v": 1}).count() for _ in range(3)}
    assert len(later) == 1 and later <= {3, 9}


def test_a_builder_that_dies_publishes_nothing(spark, tmp_path):
    place = f"{tmp_path}/{options_key({})}"
    spark.range(4).write.parquet(f"{place}/build-dead")   # files and _SUCCESS, killed before it was published
    assert published(spark, place) is None

    def dies():
        return spark.range(10).selectExpr("if(id = 7, raise_error('lost'), id) as id")

    with pytest.raises(Exception, match="lost"):
        materialise_once(spark, str(tmp_path), dies).count()
    assert published(spark, place) is None
    assert materialise_once(spark, str(tmp_path), lambda: spark.range(6)).count() == 6
    assert materialise_once(spark, str(tmp_path), lambda: 1 / 0).count() == 6
