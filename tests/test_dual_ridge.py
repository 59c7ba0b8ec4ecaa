"""Ridge over the rows against closed forms and against the pipeline of MLlib stages."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from gazrank.ml import dual_ridge as DR
from gazrank.ml import models as M
from gazrank.ml import tuning as TU
from gazrank.ml.stages import RidgeRegression, SmoothIdf, TextRidge

from test_ridge_path import WEIGHTINGS, matrix


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = [f"w{i:02d}" for i in range(40)]
    data = []
    for i in range(90):
        a = [rng.choice(words[:20 + i % 20]) for _ in range(rng.randint(0, 25))]
        b = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        data.append((i, float(a.count("w01") + 2 * b.count("w05") + rng.randint(0, 3)), float(i % 3 == 0), a, b))
    data += [(90 + i, 1.0, 0.0, ["w01", f"new{i}"], None) for i in range(5)] + [(95, 2.0, 1.0, [], [])]
    return spark.createDataFrame(data, "doc_id long, y0 double, e0 double, a array<string>, b array<string>").repartition(3).cache()


@pytest.mark.parametrize("bounds", [(1, None), (3, 0.6)])
def test_scores_equal_closed_form(rows, bounds, monkeypatch):
    # several groups of jobs, several chunks of rows, sums added on Spark
    monkeypatch.setattr(DR, "MOST_SENT", 900)
    monkeypatch.setattr(DR, "MOST_ADDED", 0)
    monkeypatch.setattr(DR, "CHUNK", 40)
    plain = [r if r.b is not None else type(r)(**{**r.asDict(), "b": []}) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    y = np.array([r.y0 for r in plain])
    data = DR.counted(rows, ["a", "b"], "y0", "e0", ["doc_id"], ["doc_id"])
    part = np.where(data.kept["doc_id"] >= 70, 2, np.where(data.kept["doc_id"] < 5, 0, 1))
    alphas = [0.5, 10.0, 300.0]
    solved = DR.solve(data, [DR.Job(w, part, data.y) for w in WEIGHTINGS], alphas, bounds, tol=1e-10)
    got = {(r.doc_id, r.candidate): r for r in DR.scores(solved, ["doc_id"]).collect()}
    data.close()
    train = [r for r in plain if 5 <= r.doc_id < 70]
    seen = {}
    for r in train:
        for t in {*r.a, *r.b}:
            seen[t] = seen.get(t, 0) + 1
    known = sorted(t for t, n in seen.items() if bounds[0] <= n <= (bounds[1] or 1) * len(train))
    assert len(got) == 91 * len(WEIGHTINGS) * len(alphas) and known
    only = [type(r)(**{**r.asDict(), "a": [t for t in r.a if t in known], "b": [t for t in r.b if t in known]}) for r in plain]
    for i, w in enumerate(WEIGHTINGS):
        # idf is that of the training rows: their matrix, then the others beside them
        own = matrix(only[5:70], known, w, 65)
        rest = matrix(only[5:70] + only[70:], known, type(w)(w.binary, False, None, w.weights, w.agg), 65)
        idf = np.array([np.log(66 / (1 + seen[t])) + 1 for t in known])
        rest = rest[:, :-1] * (idf if w.use_idf else 1.0)
        size = np.abs(rest).sum(1) if w.norm == "l1" else np.sqrt((rest ** 2).sum(1)) if w.norm else np.ones(len(rest))
        x = np.column_stack([rest / np.where(size > 0, size, 1)[:, None], [r.e0 for r in only[5:]]])
        assert np.allclose(x[:65], own)
        c, t = own - own.mean(0), y[5:70]
        for k, alpha in enumerate(alphas):
            b = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ (t - t.mean()))
            want = x @ b + t.mean() - own.mean(0) @ b
            for r, s in zip(plain[5:], want, strict=True):
                g = got[r.doc_id, i * len(alphas) + k]
                assert abs(g.score - s) < 1e-6 and g.y == r.y0 and g.part == (2 if r.doc_id >= 70 else 1)


@pytest.mark.parametrize("binary,use_idf,norm", [(True, True, ""), (False, True, "l2"), (False, False, "l1"), (True, True, "l2")])
def test_stage_equals_mllib_stages(rows, binary, use_idf, norm, tmp_path):
    from pyspark.ml.feature import Normalizer
    stages = [CountVectorizer(inputCol="a", outputCol="v", binary=binary)]
    vec = "v"
    if use_idf:
        stages.append(SmoothIdf(inputCol=vec, outputCol="i"))
        vec = "i"
    if norm:
        stages.append(Normalizer(inputCol=vec, outputCol="n", p=1.0 if norm == "l1" else 2.0))
        vec = "n"
    stages += [VectorAssembler(inputCols=[vec, "e0"], outputCol="features"),
               RidgeRegression(alpha=3.0, labelCol="y0", tol=1e-12)]
    train = rows.filter("doc_id < 70")
    # copies of a row are scored like the row
    every = rows.unionByName(rows.filter("doc_id >= 80").withColumn("doc_id", F.col("doc_id") + 100))
    want = {r.doc_id: r.prediction for r in Pipeline(stages=stages).fit(train).transform(every).collect()}
    model = Pipeline(stages=[TextRidge(alpha=3.0, termsCol="a", extraCol="e0", labelCol="y0", binary=binary, useIdf=use_idf, norm=norm)]).fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        out = m.transform(every)
        got = {r.doc_id: r.prediction for r in out.collect()}
        assert out.columns == [*every.columns, "prediction"] and got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-4 for i in want)


@pytest.fixture(scope="module")
def articles(spark):
    from gazrank.sources import tables
    from conftest import SF_SMALL
    return tables.articles(spark, SF_SMALL).filter("relevancia is not null and fulltext is not null and url is not null").filter(
        "doc_id % 3 = 0").cache()


def test_no_vocabulary_on_the_driver(articles):
    """The bigrams of section 1 are most of its model; the fitted pipeline keeps them as a table."""
    model = M.fit_cached(M.section1_model(), articles)
    assert not any(isinstance(s, (CountVectorizerModel, LinearRegressionModel)) for s in model.stages)
    terms = model.stages[-1].weights
    assert terms.count() > 1000 and terms.select("term").distinct().count() == terms.count()
    old = M.fit_cached(Pipeline(stages=M.feature_stages(1) + [RidgeRegression(alpha=10000.0, tol=1e-10)]), articles)
    a, b = ({r.doc_id: r.prediction for r in m.transform(articles).select("doc_id", "prediction").collect()} for m in (model, old))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-4


def test_curves_equal_single_fits(articles, monkeypatch):
    pipe, plain = M.section1_model(), Pipeline(stages=M.feature_stages(1) + [RidgeRegression(alpha=10000.0, tol=1e-10)])
    train, val = articles.filter("doc_id % 4 > 0"), articles.filter("doc_id % 4 = 0")
    both = [TU.learning_curve(p, train, val, steps=2).orderBy("size").collect() for p in (pipe, plain)]
    assert np.allclose(*both, atol=1e-6)
    both = [TU.cv_learning_curve(p, articles, fractions=(0.5,), k=2).collect() for p in (pipe, plain)]
    assert np.allclose(*both, atol=1e-4)
    got = TU.text_cv_scores(pipe, articles, k=2, permute_seed=7)
    for kind, want in ((got["held_out"][0], {}), (got["held_out"][1], {"on_train": True}), (got["permuted"][0], {"permute_seed": 7})):
        assert np.allclose(kind, TU.cv_scores(plain, articles, k=2, **want), atol=1e-4)
