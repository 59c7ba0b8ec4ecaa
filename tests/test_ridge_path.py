"""Ridge paths against closed forms, weighted counts against the long form, searches and curves that run."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from gazrank.ml import ridge_path as RP
from gazrank.ml.vectorizers import WeightedCounts
from gazrank.operators import vectorize as V


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = [f"w{i:02d}" for i in range(40)]
    data = []
    for i in range(90):
        a = [rng.choice(words[:20 + i % 20]) for _ in range(rng.randint(0, 25))]
        b = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        data.append((i, float(a.count("w01") + 2 * b.count("w05") + rng.randint(0, 3)), float(i % 3 == 0), a, b))
    return spark.createDataFrame(data, "doc_id long, y0 double, e0 double, a array<string>, b array<string>").repartition(3).cache()


WEIGHTINGS = [RP.Weighting(binary=x, use_idf=i, norm=n, weights=(2.0, 3.0), agg=g)
              for x in (True, False) for i in (True, False) for n in (None, "l1", "l2") for g in ("max", "sum")]


def matrix(data, vocabulary, w, n):
    """Dense features of a weighting, by their definition."""
    at = {t: i for i, t in enumerate(vocabulary)}
    df = np.zeros(len(at))
    for r in data:
        for t in {*r.a, *r.b}:
            df[at[t]] += 1
    idf = np.log((1 + n) / (1 + df)) + 1
    out = np.zeros((len(data), len(at) + 1))
    for k, r in enumerate(data):
        for t in {*r.a, *r.b}:
            c = [min(x.count(t), 1) if w.binary else x.count(t) for x in (r.a, r.b)]
            v = [u * z for u, z in zip(c, w.weights, strict=True)]
            out[k, at[t]] = (sum(v) if w.agg == "sum" else max(v)) * (idf[at[t]] if w.use_idf else 1.0)
        if w.norm:
            s = np.abs(out[k]).sum() if w.norm == "l1" else math.sqrt((out[k] ** 2).sum())
            out[k] /= s or 1.0
        out[k, -1] = r.e0
    return out


def test_paths_equal_closed_form(rows):
    model = CountVectorizer(inputCol="c", outputCol="v").fit(rows.select(F.concat("a", "b").alias("c")))
    data = RP.counted_rows(rows, model, ["a", "b"], ["doc_id"], "y0", "e0")
    alphas = [0.5, 10.0, 300.0]
    idf, paths = RP.fit_paths(data, len(model.vocabulary), WEIGHTINGS, alphas, tol=1e-9)
    plain = sorted(rows.collect(), key=lambda r: r.doc_id)
    y = np.array([r.y0 for r in plain])
    got = {(r.doc_id, r.candidate): r.score for r in RP.scores(data, ["doc_id"], WEIGHTINGS, idf, paths).collect()}
    assert len(got) == len(plain) * len(WEIGHTINGS) * len(alphas)
    for i, (w, path) in enumerate(zip(WEIGHTINGS, paths, strict=True)):
        x = matrix(plain, model.vocabulary, w, len(plain))
        c = x - x.mean(axis=0)
        for k, alpha in enumerate(alphas):
            b = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ (y - y.mean()))
            assert np.allclose(path.coefficients[k], b, atol=1e-6), (w, alpha)
            assert abs(path.intercepts[k] - (y.mean() - x.mean(axis=0) @ b)) < 1e-6
            for r, s in zip(plain, x @ b + path.intercepts[k], strict=True):
                assert abs(got[r.doc_id, i * len(alphas) + k] - s) < 1e-6


def test_path_equals_single_fit(rows):
    from pyspark.ml.feature import VectorAssembler
    from gazrank.ml.stages import RidgeRegression
    model = CountVectorizer(inputCol="a", outputCol="v", binary=True).fit(rows)
    data = RP.counted_rows(rows, model, ["a"], ["doc_id"], "y0", "e0")
    _, (path,) = RP.fit_paths(data, len(model.vocabulary), [RP.Weighting()], [3.0, 50.0])
    x = VectorAssembler(inputCols=["v", "e0"], outputCol="features").transform(model.transform(rows))
    for k, alpha in enumerate((3.0, 50.0)):
        one = RidgeRegression(alpha=alpha, labelCol="y0", tol=1e-12, maxIter=1000).fit(x)
        assert np.allclose(path.coefficients[k], one.coefficients.toArray(), atol=1e-4)
        assert abs(path.intercepts[k] - one.intercept) < 1e-4


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    words = ["alfa", "beta", "gama", "delta", "zeta", "nomear", "verba", "cargo", "x"]
    text = lambda: None if rng.random() < 0.15 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    return spark.createDataFrame([(i, text(), text(), float(i % 5)) for i in range(60)],
                                 "doc_id long, t1 string, t2 string, relevancia double").repartition(3).cache()


def entries(df, model):
    out = {}
    for r in df.collect():
        out[r.doc_id] = {model.vocabulary[i]: v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True)}
    return out


@pytest.mark.parametrize("agg,binary,weights", [("max", True, [3.0, 2.0]), ("sum", False, [1.0, 4.0]), ("max", False, [-1.0, 2.0])])
def test_weighted_counts_equal_long_form(texts, agg, binary, weights, tmp_path):
    stage = WeightedCounts(inputCols=["t1", "t2"], outputCol="features", weights=weights, agg=agg, binary=binary, minDF=2.0, maxDF=0.9)
    fitted = Pipeline(stages=[stage]).fit(texts)
    got = entries(fitted.transform(texts), fitted.stages[0])
    want = {i: {} for i in got}
    for r in V.multicolumn_counts(texts, "doc_id", ["t1", "t2"], weights, agg, binary, min_df=2, max_df=0.9)[1].collect():
        want[r.doc_id][r.term] = r.value
    assert got == want and any(want.values())
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert entries(again.transform(texts), again.stages[0]) == got


def test_key_terms(texts, tmp_path):
    stage = WeightedCounts(inputCols=["t1"], outputCol="features", keywords=["nomear cargo", "verba"], antiKeywords=["cargo"],
                           keywordWeight=10.0, binary=False)
    model = stage.fit(texts)
    plain = WeightedCounts(inputCols=["t1"], outputCol="features", binary=False).fit(texts)
    a, b = entries(model.transform(texts), model), entries(plain.transform(texts), plain)
    assert len(model.vocabulary) == 9 - 1 and sum(map(len, a.values())) > 100
    assert a == {i: {t: v * (10.0 if t in ("nomear", "verba") else 1.0) for t, v in e.items()} for i, e in b.items()}
    model.write().overwrite().save(str(tmp_path / "model"))
    assert entries(type(model).load(str(tmp_path / "model")).transform(texts), model) == a
    with pytest.raises(ValueError):
        WeightedCounts(inputCols=["t1", "t2"], outputCol="f", weights=[1.0]).fit(texts)
