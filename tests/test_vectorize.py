"""Normed tf-idf entries on a small table."""

import math

from gazrank.operators import vectorize as V


def test_tfidf_norms(spark):
    terms = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "z", 1)], "doc_id long, term string, tf long")
    vocab = spark.createDataFrame([("a", 2), ("b", 1)], "term string, df long")
    idf = V.sklearn_idf(vocab, 2)
    want = {("a"): math.log(3 / 3) + 1, ("b"): math.log(3 / 2) + 1}
    plain = {(r.doc_id, r.term): r.value for r in V.tfidf(terms, idf, "doc_id").collect()}
    assert plain == {(1, "a"): want["a"], (1, "b"): 2 * want["b"], (2, "a"): 3 * want["a"]}
    l2 = {(r.doc_id, r.term): r.value for r in V.tfidf(terms, idf, "doc_id", norm="l2").collect()}
    assert math.isclose(l2[1, "a"], want["a"] / math.hypot(want["a"], 2 * want["b"])) and l2[2, "a"] == 1.0
    l1 = {(r.doc_id, r.term): r.value for r in V.tfidf(terms, idf, "doc_id", use_idf=False, norm="l1").collect()}
    assert math.isclose(l1[1, "b"], 2 / 3) and l1[2, "a"] == 1.0


def test_multicolumn_joins_only_for_bounds(spark):
    df = spark.createDataFrame([(1, "aa bb", "bb cc"), (2, "aa", None), (3, "dd", "aa")], "id long, t1 string, t2 string")
    plans = []
    for bounds in ({}, {"min_df": 2}):
        _, vals = V.multicolumn_counts(df, "id", ["t1", "t2"], [2.0, 1.0], "max", **bounds)
        plans.append("leftsemi" in vals._jdf.queryExecution().optimizedPlan().toString().lower())
        got = {(r.id, r.term): r.value for r in vals.collect()}
        every = {(1, "aa"): 2.0, (1, "bb"): 2.0, (1, "cc"): 1.0, (2, "aa"): 2.0, (3, "dd"): 2.0, (3, "aa"): 1.0}
        assert got == {k: v for k, v in every.items() if not bounds or k[1] == "aa"}
    assert plans == [False, True]
