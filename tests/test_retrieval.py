import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparqa.operators import retrieval, set_search, vector_search


def test_vector_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity)
           for r in retrieval.retrieve_vectors(df.repartition(5), df, sim="cosine", exclude_self=True).collect()}
    v = vecs.astype(np.float64)
    s = np.round((v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 6)
    for q in range(len(v)):
        order = sorted((-s[q, c], c) for c in range(len(v)) if c != q)[:2]
        for rank, (neg, c) in enumerate(order, 1):
            assert got[(q, rank)] == (c, -neg)


def _top(ids, scores, k):
    return [(c, s) for s, c in sorted(((-s, c) for c, s in zip(ids, scores)))[:k]]


def _brute(vecs, queries, sim, k, own=True):
    v, q = np.array(vecs, float), np.array(queries, float)
    s = q @ v.T
    if sim == "cosine":
        s = s / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
    s = np.round(s, 6)
    return {(i, r): (c, -neg) for i in range(len(q)) for r, (c, neg) in enumerate(_top(
        [c for c in range(len(v)) if own or c != i], [s[i, c] for c in range(len(v)) if own or c != i], k), 1)}


def _clustered(rng, n=400, d=6, groups=12):
    centres = rng.normal(size=(groups, d)) * 20
    return (centres[np.arange(n) % groups] + rng.normal(size=(n, d)) * .3).round(3).tolist()


def _pairs(index, queries, k):
    first = vector_search.stored(index.meet(index._placed(queries, True), k, True), "t")
    return queries.count() + vector_search.rest(index, queries, first, k).count()


@pytest.mark.parametrize("sim", ["cosine", "dot_product"])
def test_blocks_below_the_floor_are_not_met(spark, sim):
    """Clustered vectors: nearly all (query, block) pairs fall away, and the result is that of brute force."""
    vecs = _clustered(np.random.default_rng(5))
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = retrieval.top_k(df, df, "vec_id", df.embedding, ["vec_id"], df.embedding, sim, 3, exclude_self=True,
                          centres=24, block_bytes=56 * 10, direct_cells=0)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in got.collect()} == _brute(vecs, vecs, sim, 3, own=False)
    q, c = df.selectExpr("vec_id AS query_id", "embedding AS __qv"), df.selectExpr("vec_id", "embedding AS __cv")
    index = vector_search.VectorIndex(c, ["vec_id"], sim, 24, 56 * 10)
    every = len(vecs) * len(index.block_ids)
    assert len(index.block_ids) > 30 and _pairs(index, q, 3) < every * .35


@pytest.mark.parametrize("sim", ["cosine", "dot_product"])
def test_adversarial_vectors_lose_nothing(spark, sim):
    """Vectors without clusters, many ties, one far longer than all: the bounds may prune nothing, the result holds."""
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(150, 12)).round(1).tolist() + [[1.0] * 12] * 30 + [[1e6] * 12] + [[-1e-9] * 12]
    odd = [None, [float("nan")] * 12, [float("inf")] + [0.0] * 11] + ([[0.0] * 12] if sim == "cosine" else [])
    df = spark.createDataFrame(list(enumerate([*vecs, *odd])), "vec_id long, embedding array<double>")
    got = retrieval.top_k(df, df, "vec_id", df.embedding, ["vec_id"], df.embedding, sim, 4, centres=16, block_bytes=104 * 7, direct_cells=0)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in got.collect()} == _brute(vecs, vecs, sim, 4)
    direct = retrieval.top_k(df, df, "vec_id", df.embedding, ["vec_id"], df.embedding, sim, 4)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, got.collect()))


def test_a_step_of_the_search_holds_no_vector_twice(spark):
    """A query that meets every block leaves Python once, with its blocks."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)], "id long, __cv array<double>")
    index = vector_search.VectorIndex(df, ["id"], "dot_product", centres=8, block_bytes=100)
    queries = df.selectExpr("id AS query_id", "__cv AS __qv")
    left = index._placed(queries.selectExpr("*", "cast(null AS double) AS floor"), False)
    rows = left.collect()
    assert len(rows) == 90 and {len(r.blocks) for r in rows} == {len(index.block_ids) - 1} and len(index.block_ids) > 4  # all but the first


@pytest.mark.parametrize("sim", ["cosine", "dot_product"])
@pytest.mark.parametrize("cells,queries", [(1, 1), (40, 8), (1 << 20, 256)])
def test_block_search_with_ties_and_small_steps(monkeypatch, sim, cells, queries):
    """Copies of a vector pile up in no step: k rows a query, ties to the smaller id, in steps of any size."""
    import pandas as pd
    monkeypatch.setattr(vector_search, "PAIR_BLOCK", cells)
    monkeypatch.setattr(vector_search, "QUERY_STEP", queries)
    rng = np.random.default_rng(3)
    vecs = [[1.0, 2.0]] * 40 + rng.normal(size=(25, 2)).round(1).tolist() + [[-3.0, -1.0]] * 9
    at = rng.permutation(len(vecs))
    corpus = pd.DataFrame({"vec_id": at, "__cv": [np.array(vecs[i]) for i in at]})
    asked = corpus.rename(columns={"vec_id": "query_id", "__cv": "__qv"})
    got = vector_search._best(asked, corpus, sim, 3, ["vec_id"], True)
    assert len(got) == 3 * len(vecs)
    got = got.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True])
    got["rank"] = got.groupby("query_id").cumcount() + 1
    assert {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in got.itertuples()} == _brute(vecs, vecs, sim, 3, own=False)


def test_vector_search_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for part, rows in ((df, 2), (df.where("vec_id = 1"), 1), (df.where("false"), 0)):
        for cells in (0, 1 << 26):
            got = retrieval.top_k(df, part, "vec_id", df.embedding, ["vec_id"], df.embedding, "cosine", 5, direct_cells=cells)
            assert got.count() == 2 * rows
            assert retrieval.top_k(df.where("false"), part, "vec_id", df.embedding, ["vec_id"], df.embedding, direct_cells=cells).count() == 0


def test_jaccard_and_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x y"), (3, "   "), (4, "a b")], "doc_id long, text string")
    chunks = retrieval.chunk_documents(docs, chunk_tokens=2, max_chunks=4)
    assert [(r.doc_id, r.chunk_idx, r.text) for r in chunks.orderBy("doc_id", "chunk_idx").collect()] == \
        [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (2, 0, "x y")]
    q = spark.createDataFrame([(10, "A b"), (11, "zzz")], "item_id long, text string")
    corpus = retrieval.chunk_documents(docs, chunk_tokens=2, max_chunks=None)
    got = [(r.query_id, r["rank"], r.doc_id, r.chunk_idx, r.similarity)
           for r in retrieval.retrieve_text(q, corpus, "item_id", "text", ["doc_id", "chunk_idx"], "text")
           .orderBy("query_id", "rank").collect()]
    # zero is a legal similarity: every query gets its k rows
    assert got == [(10, 1, 1, 0, 1.0), (10, 2, 4, 0, 1.0), (11, 1, 1, 0, 0.0), (11, 2, 1, 1, 0.0)]


def _jaccard(queries, sets, k):
    out = {}
    for i, q in enumerate(queries):
        scores = [round(len(q & s) / len(q | s), 6) if q & s else 0.0 for s in sets]
        for r, (c, neg) in enumerate(_top(range(len(sets)), scores, k), 1):
            out[f"q{i}", r] = (c, -neg)
    return out


@pytest.mark.parametrize("head,near", [(1, 0), (64, 1 << 19)])
def test_set_search_is_exact(spark, monkeypatch, head, near):
    """Common and rare tokens, ties, empty sets, queries that share nothing; with hardly any seeds and with many."""
    monkeypatch.setattr(set_search, "HEAD", head)
    monkeypatch.setattr(set_search, "NEAR_ROWS", near)
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 1 + i % 23) % 60) for i in range(160)] + ["", "!", "w1 w1 W1", "w1"]
    asked = texts[:25] + ["", "only new words here", "w1", "w2 brandnew", texts[40] + " w999"]
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)] + [("null", None)], "item_id string, text string")
    c = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    for k in (1, 3, 200):
        got = retrieval.retrieve_text(q, c, "item_id", "text", ["doc_id"], "text", k=k).collect()
        tokens = lambda t: set(re.findall(r"\w+", t.lower()))
        assert {(r.query_id, r["rank"]): (r.doc_id, r.similarity) for r in got} == _jaccard([*map(tokens, asked)], [*map(tokens, texts)], k)


def test_few_candidate_pairs_are_compared(spark):
    """Every query has near copies in the corpus and all sets share common tokens: pairs are far fewer than queries x corpus."""
    rng = np.random.default_rng(6)
    base = [[f"t{i}_{j}" for j in range(20)] + [f"common{j}" for j in range(15)] for i in range(60)]
    corpus = [" ".join([*rng.permutation(b)[:30], f"x{i}_{k}"]) for i, b in enumerate(base) for k in range(8)]
    q = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base)], "query_id long, text string").select("query_id", retrieval.token_hashes("text").alias("__qv"))
    c = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").select("doc_id", retrieval.token_hashes("text").alias("__cv"))
    index = set_search.SetIndex(q, c, ["doc_id"])
    seeds = index.compared(index.seeds())
    floors = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), asc=False)[1].alias("floor"))
    met = index.seeds().unionByName(index.candidates(floors)).distinct().count()
    assert met <= 60 * 8 * 1.2 < 60 * len(corpus) / 20


def test_compound_ids_and_no_corpus(spark):
    q = spark.createDataFrame([(1, [7, 8]), (2, [])], "query_id long, __qv array<long>")
    c = spark.createDataFrame([("b", 2, [7]), ("a", 9, [7]), ("b", 1, [5])], "doc string, part int, __cv array<long>")
    got = sorted(map(tuple, set_search.top_k_sets(q, c, ["doc", "part"], 2).collect()))
    assert got == [(1, 1, "a", 9, .5), (1, 2, "b", 2, .5), (2, 1, "a", 9, 0.0), (2, 2, "b", 1, 0.0)]
    assert set_search.top_k_sets(q, c.where("false"), ["doc", "part"], 2).count() == 0
    own = spark.createDataFrame([(1, [7]), (2, [7]), (3, [9])], "id long, __cv array<long>")
    pairs = set_search.top_k_sets(own.selectExpr("id AS query_id", "__cv AS __qv"), own, ["id"], 1, exclude_self=True)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0), (3, 1, 1, 0.0)]


def test_no_query_row_reaches_the_driver(spark, monkeypatch):
    df = spark.range(30).selectExpr("id AS vec_id", "array(cast(id AS double), 1D) AS embedding")
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(out := collect(self)) or out)
    monkeypatch.setattr(type(df), "toPandas", lambda self: seen.append(out := collect(self)) or out)
    plan = retrieval.retrieve_vectors(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    assert not seen  # the sides are only counted


def test_pair_similarity_functions(spark):
    from sparqa.functions import similarity as sim
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], ["a", "b"], ["b", "c", "c"]),
                                ([0.0, 0.0], [1.0, 1.0], [], [])],
                               "a array<double>, b array<double>, s array<string>, t array<string>")
    r = df.select(sim.dot("a", "b").alias("d"), sim.cosine("a", "b").alias("c"),
                  sim.jaccard("s", "t").alias("j")).collect()
    assert r[0].d == 4.0 and abs(r[0].c - 4.0 / (3.0 * 5 ** 0.5)) < 1e-12 and abs(r[0].j - 1 / 3) < 1e-12
    assert r[1].c is None and r[1].j == 0.0
