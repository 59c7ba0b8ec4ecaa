"""Splits (the reference's assertions as tests), ridge vs normal equations,
vote, sparse max property, multi-column toy fixture."""

import random

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gazrank.ml.models import hard_vote
from gazrank.ml.stages import RidgeRegression
from gazrank.operators import splits as S
from gazrank.operators import vectorize as V


def _ids(spark, n=1003):
    return spark.createDataFrame([(i, 1 + i % 5) for i in range(n)], "doc_id long, relevancia int")


def test_exact_size_sets(spark):
    df = _ids(spark)
    out = S.random_set_split(df, [0.7, 0.15, 0.15], seed=3)
    sizes = {r["set_id"]: r["count"] for r in out.groupBy("set_id").count().collect()}
    assert sizes == dict(enumerate(S.set_sizes(1003, [0.7, 0.15, 0.15])))
    assert out.select("doc_id").distinct().count() == 1003


def test_stratified_and_kfold(spark):
    df = _ids(spark)
    tr, te = S.stratified_split(df, "relevancia", 0.2)
    assert tr.count() + te.count() == 1003
    assert tr.join(te, "doc_id").count() == 0
    counts = {r["relevancia"]: r["count"] for r in te.groupBy("relevancia").count().collect()}
    assert max(counts.values()) - min(counts.values()) <= 1
    folds = S.with_kfold(df, 5)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [200, 200, 201, 201, 201]


def test_ridge_normal_equations(spark):
    rng = np.random.default_rng(0)
    n, p, alpha = 50, 6, 7.0
    X = (rng.random((n, p)) < 0.4).astype(float)
    y = rng.integers(1, 6, n).astype(float)
    df = spark.createDataFrame([(Vectors.dense(X[i]), float(y[i])) for i in range(n)],
                               ["features", "relevancia"])
    m = RidgeRegression(alpha=alpha, tol=1e-10).fit(df)
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(p), Xc.T @ yc)
    assert np.abs(m.coefficients.toArray() - b).max() < 1e-5
    assert abs(m.intercept - (y.mean() - X.mean(0) @ b)) < 1e-5


def test_sparse_max_property(spark):
    rnd = random.Random(0)
    for _ in range(3):
        a = [(i, j, float(rnd.randint(-9, 9))) for i in range(5) for j in range(5)]
        b = [(i, j, float(rnd.randint(-9, 9))) for i in range(5) for j in range(5)]
        da = spark.createDataFrame(a, "r int, c int, value double").filter(F.col("value") != 0)
        db = spark.createDataFrame(b, "r int, c int, value double").filter(F.col("value") != 0)
        m1 = {(r["r"], r["c"]): r["value"] for r in V.sparse_max(da, db, ["r", "c"]).collect()}
        m2 = {(r["r"], r["c"]): r["value"] for r in V.sparse_max(db, da, ["r", "c"]).collect()}
        assert m1 == m2
        for (i, j, va), (_, _, vb) in zip(a, b):
            assert m1.get((i, j), 0.0) >= va and m1.get((i, j), 0.0) >= vb


def test_multicolumn_toy(spark):
    rows = [(0, "portaria", "coisa ruim", "fala qualquer coisa"),
            (1, "portaria", "nem avisa", "coisa ruim"),
            (2, "decreto", "altera o decreto", "verifica a portaria")]
    df = spark.createDataFrame(rows, "id int, t1 string, t2 string, t3 string")
    vocab, vals = V.multicolumn_counts(df, "id", ["t1", "t2", "t3"], [1.0, 1.0, 1.0], agg="max")
    terms = sorted(r["term"] for r in vocab.collect())
    assert terms == sorted({"portaria", "coisa", "ruim", "fala", "qualquer", "nem", "avisa", "decreto",
                            "altera", "verifica"})
    got = {(r["id"], r["term"]): r["value"] for r in vals.collect()}
    assert got[(0, "coisa")] == 1.0 and got[(2, "decreto")] == 1.0 and (1, "fala") not in got


def test_hard_vote_ties_smallest(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (2, 4), (2, 1)], "id int, label int")
    got = {r["id"]: r["vote"] for r in hard_vote(df, "id").collect()}
    assert got == {1: 2, 2: 4}


def test_stemmer_hook(spark):
    class _SuffixStemmer:  # local: shipped to the Python workers by value
        def stem(self, w):
            return w[:-1] if w.endswith("s") else w

    df = spark.createDataFrame([(1, "cargos"), (1, "cargo"), (2, "atos")], "doc_id int, term string")
    got = sorted((r["doc_id"], r["term"]) for r in V.stem_terms(df, _SuffixStemmer()).collect())
    assert got == [(1, "cargo"), (1, "cargo"), (2, "ato")]
    assert V.stem_terms(df, None) is df


def test_column_selector_passthrough(spark):
    from pyspark.ml import Pipeline
    from gazrank.ml.models import column_selector
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    out = Pipeline(stages=column_selector(["a", "b"])).fit(df).transform(df)
    assert [list(r["features"]) for r in out.collect()] == [[1.0, 2.0], [3.0, 4.0]]
