import pytest
from pyspark.sql import functions as F

from sparqa.operators import sampling


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 5003).withColumnRenamed("id", "k")


def _positions(df, key="k", out="pos"):
    return {r[key]: r[out] for r in df.collect()}


def test_positions_are_a_permutation_matching_a_global_sort(spark, ids):
    got = _positions(sampling.with_position(ids, "k", "pos", order="hash", seed=42))
    ref = ids.withColumn("h", sampling.seeded_hash("k", 42)).orderBy("h", "k").collect()
    assert got == {r.k: i for i, r in enumerate(ref)}


def test_key_order_positions(spark, ids):
    got = _positions(sampling.with_position(ids.where("k % 3 != 0"), "k", "pos", order="key"))
    keys = sorted(got)
    assert [got[k] for k in keys] == list(range(len(keys)))


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_split_is_exact_and_partition_independent(spark, ids, parts):
    base = {r.k: r.split for r in sampling.split_train_test(ids, "k", 0.95).collect()}
    again = {r.k: r.split for r in sampling.split_train_test(ids.repartition(parts), "k", 0.95).collect()}
    assert base == again
    n = 5003
    assert sum(v == "train" for v in base.values()) == int(0.95 * n)
    assert set(base) == set(range(n))


def test_sample_exact(spark, ids):
    s = sampling.sample_exact(ids, "k", 777).collect()
    assert len(s) == 777 and len({r.k for r in s}) == 777
    assert sampling.sample_exact(ids, "k", 10**6).count() == 5003
    with pytest.raises(ValueError):
        sampling.sample_exact(ids, "k", 10**6, strict=True)


def test_shards_are_contiguous_with_hf_sizes(spark, ids):
    got = _positions(sampling.shard_index(ids, "k", 7, order="key"), out="shard")
    n, k = 5003, 7
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    expect, start = {}, 0
    for i, size in enumerate(sizes):
        for key in range(start, start + size):
            expect[key] = i
        start += size
    assert got == expect
    first = sampling.shard(ids, "k", 10, 0).collect()
    assert sorted(r.k for r in first) == list(range(501))
    rest = sampling.shard(ids, "k", 10, 0, exclude=True).count()
    assert rest == 5003 - 501


def test_split_only_ranks_boundary_buckets(spark, ids):
    plan = sampling.split_train_test(ids, "k", 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_narrowing_over_several_steps_is_exact(spark, ids, monkeypatch):
    ref = [r.k for r in ids.withColumn("h", sampling.seeded_hash("k", 42)).orderBy("h", "k").collect()]
    for name, value in (("BUCKET_ROWS", 400), ("FEW_ROWS", 100), ("HASH_DIGITS", 1), ("RANGES", 12)):
        monkeypatch.setattr(sampling, name, value)
    assert _positions(sampling.with_position(ids, "k", "pos", order="hash", seed=42)) == {k: i for i, k in enumerate(ref)}
    assert _positions(sampling.with_position(ids, "k", "pos", order="key")) == {k: k for k in range(5003)}
    assert {r.k for r in sampling.sample_exact(ids, "k", 1234).collect()} == set(ref[:1234])
    shards = _positions(sampling.shard_index(ids, "k", 4, order="hash"), out="shard")
    sizes = [5003 // 4 + (i < 5003 % 4) for i in range(4)]
    assert [shards[k] for k in ref] == [i for i, n in enumerate(sizes) for _ in range(n)]
    by_key = _positions(sampling.shard_index(ids, "k", 4, order="key"), out="shard")
    assert [by_key[k] for k in range(5003)] == [i for i, n in enumerate(sizes) for _ in range(n)]


@pytest.mark.parametrize("kind", ["string", "decimal(20,4)", "date", "timestamp", "double"])
@pytest.mark.parametrize("few", [5, 4096])
def test_cuts_and_positions_of_any_orderable_key(spark, monkeypatch, kind, few):
    monkeypatch.setattr(sampling, "FEW_ROWS", few)
    monkeypatch.setattr(sampling, "RANGES", 8)
    make = {"string": "concat('k', id * 7919 % 1000)", "decimal(20,4)": "cast((id - 300) / 8 as decimal(20,4))", "date": "date_add(date'2000-01-01', cast(id as int))",
            "timestamp": "timestamp_seconds(id * 1000 + id / 7)", "double": "(id - 500) / 7D"}[kind]
    df = spark.range(400).selectExpr("id", f"{make} AS k").unionByName(spark.range(1).selectExpr("id + 400 AS id", f"cast(null AS {kind}) AS k"))
    ref = [r.id for r in df.orderBy("k").collect()]
    pos = _positions(sampling.with_position(df, "k", "pos", order="key"), key="id")
    assert [pos[i] for i in ref] == list(range(401))
    got = _positions(sampling.shard_index(df, "k", 4, order="key"), key="id", out="shard")
    assert [got[i] for i in ref] == [0] * 101 + [1] * 100 + [2] * 100 + [3] * 100
    for order in ("key", "hash"):
        split = _positions(sampling.split_train_test(df, "k", 0.3, order=order), key="id", out="split")
        assert sum(v == "train" for v in split.values()) == 120
        if order == "key":
            assert all(split[i] == "train" for i in ref[:120])


@pytest.mark.parametrize("n", [0, 1, 5003, 6000])
def test_cuts_at_the_ends(spark, ids, n):
    assert sampling.sample_exact(ids, "k", n).count() == min(n, 5003)
    assert sampling.shard_index(ids.where(f"k < {n}"), "k", 5).groupBy("shard").count().count() == (0 if n == 0 else min(n, 5))
    assert sampling.with_position(ids.where(f"k < {n}"), "k").count() == min(n, 5003)
    assert sampling.split_train_test(ids.where(f"k < {n}"), "k", 0.5, stratify=("k",)).count() == min(n, 5003)


def test_wide_rows_are_only_filtered(spark):
    """One scan: no join, window or exchange over the wide rows."""
    wide = spark.range(5000).selectExpr("id AS k", "repeat('x', 100) AS text")
    for df in (sampling.sample_exact(wide, "k", 100), sampling.split_train_test(wide, "k"), sampling.shard_index(wide, "k", 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Window", "Exchange"))


def test_very_many_strata(spark, monkeypatch):
    """More strata than may go to all tasks: nothing is collected or broadcast, sizes are those of each stratum alone."""
    monkeypatch.setattr(sampling, "NEAR_ROWS", 1000)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    n = 1_000_000
    df = spark.range(n).selectExpr("id AS k", "CASE WHEN id < 300000 THEN -1 ELSE id % 700000 END AS g")  # a third in one stratum
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = sampling.split_train_test(df, "k", 0.95, stratify=("g",))
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SinglePartition" not in plan
        big, small = split.where("g = -1").groupBy("split").count().collect(), split.where("g >= 0").groupBy("split").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.split: r["count"] for r in big} == {"train": 285_000, "test": 15_000}
    assert {r.split: r["count"] for r in small} == {"test": 700_000}


def test_stratified_split(spark, ids):
    df = ids.withColumn("g", (F.col("k") % 3).cast("string"))
    got = sampling.split_train_test(df, "k", 0.95, stratify=("g",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    for g, rows in by.items():
        n = len(rows)
        assert sum(r.split == "train" for r in rows) == int(0.95 * n)
    assert len(got) == 5003
    pos = sampling.with_position(df, "k", "pos", by=("g",)).collect()
    for g in ("0", "1", "2"):
        ps = sorted(r.pos for r in pos if r.g == g)
        assert ps == list(range(len(ps)))


def test_split_covers_input_exactly_once(spark, ids):
    s = sampling.split_train_test(ids, "k", 0.95)
    train = {r.k for r in s.where("split = 'train'").collect()}
    test = {r.k for r in s.where("split = 'test'").collect()}
    assert not (train & test) and train | test == set(range(5003))


@pytest.mark.parametrize("fn", [
    lambda d: sampling.split_train_test(d, "k", 0.95),
    lambda d: sampling.with_position(d, "k", "pos"),
    lambda d: sampling.sample_exact(d, "k", 100),
    lambda d: sampling.shard_index(d, "k", 10),
])
def test_no_single_partition_exchange_over_data(spark, ids, fn):
    plan = fn(ids)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_null_keys_and_strata_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (4, None), (5, "b")], "k long, g string")
    assert sampling.split_train_test(df, "k", 0.5).count() == 5
    assert sampling.split_train_test(df, "k", 0.5, stratify=("g",)).count() == 5
    pos = sampling.with_position(df, "k", "pos", order="key").collect()
    assert sorted(r.pos for r in pos) == list(range(5))
    assert [r.k for r in sorted(pos, key=lambda r: r.pos)][0] is None


def test_sample_exact_many_equals_single(spark, ids):
    other = spark.range(100, 900).withColumnRenamed("id", "j")
    a, b = sampling.sample_exact_many([(ids, "k", 300), (other, "j", 50)])
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in sampling.sample_exact(ids, "k", 300).collect())
    assert sorted(r.j for r in b.collect()) == sorted(r.j for r in sampling.sample_exact(other, "j", 50).collect())


def test_split_cut_is_pythons_float_product(spark):
    fracs = [0.95, 0.29, 0.7, 0.1, 0.333, 0.5, 0.9]
    ns = list(range(0, 3000, 7)) + [10**6 + 1, 1999999]
    df = spark.createDataFrame([(f, n) for f in fracs for n in ns], "f double, n long")
    got = {(r.f, r.n): r.cut for r in df.select("f", "n", F.floor(F.col("n").cast("double") * F.col("f"))
                                                 .cast("long").alias("cut")).collect()}
    assert got == {(f, n): int(f * n) for f in fracs for n in ns}
    s = sampling.split_train_test(spark.range(100).withColumnRenamed("id", "k"), "k", 0.29)
    assert s.where("split = 'train'").count() == int(0.29 * 100) == 28
