import importlib

import pytest

from conftest import SF_SMALL


def test_entry_runs(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["row_id", "question", "reasoning", "answer", "source"]


def test_every_query_has_oracle_or_is_listed():
    E = importlib.import_module("__spark_entry__")
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(_LIBRARY) <= set(E.queries())
    assert set(_LIBRARY) - set(E.oracle_sql()) == set()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the library's own queries; those of the training-data operators are tested in their own folder
_LIBRARY = importlib.import_module("sparqa.plans.queries").QUERIES


@pytest.mark.parametrize("name", sorted(_LIBRARY))
def test_plans_have_no_python_udf_or_cross_product(spark, name):
    p = _plan(_LIBRARY[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)
    if not name.startswith("retrieve_"):
        assert "MapInPandas" not in p, name   # Python only in the similarity kernel


def test_prefilter_is_pushed_to_parquet(spark):
    from sparqa.operators import curate
    from sparqa.sources.tables import table
    src = table(spark, SF_SMALL, "customer").selectExpr(
        "c_custkey", "'q' AS question", "'a' AS opa", "'b' AS opb", "'c' AS opc", "'d' AS opd",
        "CAST(c_custkey % 4 AS INT) AS cop", "c_name AS exp", "c_mktsegment AS choice_type")
    p = _plan(curate.curate_fourcol(src))
    pushed = p[p.index("PushedFilters: ["):].split("]")[0]
    for f in ("IsNotNull(c_name)", "EqualTo(c_mktsegment,single)"):
        assert f in pushed


def test_boxed_extraction_is_evaluated_once(spark):
    E = importlib.import_module("__spark_entry__")
    p = _plan(E.queries()["curate_boxed"](spark, SF_SMALL))
    assert p.count("(?:[^{}]++") == 2        # rlike + extract, inside one bound expression
    assert "isnotnull(concat" not in p


def test_length_profile_approx_close_to_exact(spark):
    from sparqa.operators import profile
    df = spark.range(1, 2001).selectExpr("repeat('x', CAST(id AS INT)) AS text", "'s' AS source")
    ex = profile.length_profile(df, by=None).first()
    ap = profile.length_profile(df, by=None, exact=False).first()
    assert ex.median_len == 1000 and ex.p90_len == 1800 and ex.max_len == 2000
    assert abs(ap.median_len - ex.median_len) <= 2 and abs(ap.p90_len - ex.p90_len) <= 2
