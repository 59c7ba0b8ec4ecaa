"""Cross-validation, curves, searches, bundles, baselines and bagging on a small numeric table."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gazrank.ml import models as M
from gazrank.ml import tuning as TU
from gazrank.ml.stages import RidgeRegression
from gazrank.operators import ranking as RK
from gazrank.operators import splits as S
from gazrank.sources import io as IO



def pipe():
    return [VectorAssembler(inputCols=["a", "b"], outputCol="features")]


def ridge(**kw):
    return Pipeline(stages=pipe() + [RidgeRegression(alpha=1.0, tol=1e-10, **kw)])


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, float(min(5, max(0, round(2 + a - 0.5 * b + rng.gauss(0, 0.4)))))))
    return spark.createDataFrame(rows, "doc_id long, a double, b double, relevancia double").repartition(4).cache()


def solve(x, y, alpha=1.0, w=None):
    w = np.ones(len(y)) if w is None else w
    mx, my = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
    c = x - mx
    b = np.linalg.solve(c.T @ (w[:, None] * c) + alpha * np.eye(x.shape[1]), c.T @ (w * (y - my)))
    return b, my - mx @ b


def arrays(df):
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    return np.array([[r.a, r.b] for r in rows]), np.array([r.relevancia for r in rows]), rows


def test_cross_validation_equals_closed_form(table):
    folded = S.with_kfold(table, 4, "doc_id", None)
    x, y, rows = arrays(folded)
    fold = np.array([r.fold for r in rows])
    held, seen = [], []
    for i in range(4):
        b, c = solve(x[fold != i], y[fold != i])
        held.append(math.sqrt(((x @ b + c - y)[fold == i] ** 2).mean()))
        seen.append(math.sqrt(((x @ b + c - y)[fold != i] ** 2).mean()))
    assert np.allclose(TU.cv_scores(ridge(), table, k=4), held, atol=1e-4)
    assert np.allclose(TU.cv_scores(ridge(), table, k=4, on_train=True), seen, atol=1e-4)
    assert np.mean(TU.cv_scores(ridge(), table, k=4, permute_seed=3)) > 1.5 * np.mean(held)


def test_out_of_fold_predictions(table):
    out = TU.cross_val_predict(ridge(), table, k=3)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(120))
    assert max(len([r for r in rows if r.fold == i]) for i in range(3)) == 40
    x, y, own = arrays(table)
    at = {r.doc_id: k for k, r in enumerate(own)}
    fold = np.zeros(120)
    for r in rows:
        fold[at[r.doc_id]] = r.fold
    for r in rows[:20]:
        b, c = solve(x[fold != r.fold], y[fold != r.fold])
        assert abs(r.prediction - (x[at[r.doc_id]] @ b + c)) < 1e-4


def test_decisions_and_their_curves(table):
    model = Pipeline(stages=pipe() + [LogisticRegression(labelCol="y", regParam=0.1)])
    d = TU.cross_val_decisions(model, table.withColumn("y", (F.col("relevancia") >= 4).cast("double")), k=3)
    rows = d.collect()
    assert sorted(r.doc_id for r in rows) == list(range(120)) and {r.fold for r in rows} == {0, 1, 2}
    relevant, other = ([r.decision for r in rows if (r.relevancia >= 4) == x] for x in (True, False))
    assert np.mean(relevant) > np.mean(other) + 0.5
    curve = RK.threshold_curve(d, score="decision").orderBy(F.desc("threshold")).collect()
    for p in curve:
        assert p.tp == sum(v >= p.threshold for v in relevant) and p.fp == sum(v >= p.threshold for v in other)
        assert abs(p.precision - p.tp / (p.tp + p.fp)) < 1e-12 and abs(p.recall - p.tp / len(relevant)) < 1e-12
    # Ties are one point.
    tied = RK.threshold_curve(d.withColumn("decision", F.round("decision", 0)), score="decision")
    assert tied.count() == len({round(r.decision) for r in rows})


def test_learning_curves(table):
    train, val = table.filter("doc_id < 90"), table.filter("doc_id >= 90")
    got = TU.learning_curve(ridge(), train, val, steps=3, metric="rmse").orderBy("size").collect()
    assert [r["size"] for r in got] == [30, 60, 90]
    pos = {r.doc_id: r.p for r in S.shuffled_positions(train, "doc_id", 42, name="p").collect()}
    x, y, rows = arrays(train)
    vx, vy, _ = arrays(val)
    for r in got:
        part = np.array([pos[q.doc_id] <= r["size"] for q in rows])
        b, c = solve(x[part], y[part])
        assert abs(r.train_score - math.sqrt(((x @ b + c - y)[part] ** 2).mean())) < 1e-4
        assert abs(r.val_score - math.sqrt(((vx @ b + c - vy) ** 2).mean())) < 1e-4
    recall = TU.learning_curve(ridge(), train, val, steps=2).collect()
    assert all(0.5 < r.val_score <= 1.0 for r in recall)


def test_cv_learning_curve_with_random_band(table):
    make = lambda: TU.cv_learning_curve(ridge(), table, fractions=(0.3, 1.0), k=3).orderBy("fraction").collect()
    got = make()
    assert got == make()
    for r in got:
        assert r.mean_score < r.mean_random and r.std_random >= 0
        assert r.mean_train_score <= r.mean_score + 0.1


def test_grouped_scores(table):
    p = table.withColumn("prediction", F.col("a"))
    q = table.withColumn("prediction", F.col("relevancia"))
    for metric in ("rmse", "cum_recall"):
        one = [TU._score(x, metric) for x in (p, q, p.filter("relevancia < 4"))]
        assert np.allclose(TU.grouped_scores([p, q, p.filter("relevancia < 4")], metric), one, equal_nan=True)


@pytest.mark.parametrize("bootstrap", [True, False])
def test_bagged_ridge_weights_equal_repeated_rows(spark, table, bootstrap, tmp_path):
    weighted = M.bag_weights(table, 3, 0.7 if bootstrap else 1.0, seed=5, bootstrap=bootstrap).cache()
    take = 84 if bootstrap else 120
    x, y, rows = arrays(weighted)
    model = Pipeline(stages=pipe() + M.bagged_ridge(3, alpha=2.0)).fit(weighted)
    want = []
    for i in range(3):
        w = np.array([r[f"bag_{i}"] for r in rows])
        assert w.sum() == take and (w == 1).all() != bootstrap
        again = np.repeat(np.arange(120), w.astype(int))
        b, c = solve(x[again], y[again], 2.0)
        assert np.allclose(solve(x, y, 2.0, w)[0], b)
        want.append(x @ b + c)
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        got = {r.doc_id: r.prediction for r in m.transform(table).collect()}
        assert np.allclose([got[r.doc_id] for r in rows], np.mean(want, axis=0), atol=1e-3)


def test_baselines_and_bootstrap(table):
    got = TU.baseline_random(table, k=4).collect()
    assert {r.baseline for r in got} == {"constant", "uniform", "frequency"} and got[0].mean_score == min(r.mean_score for r in got)
    pred = table.withColumn("prediction", F.col("a") + 2)
    weights = table.groupBy("relevancia").agg((1.0 / F.count("*")).alias("weight"))
    trials = TU.bootstrap_metrics(pred, weights, trials=6, seed=4).orderBy("trial").collect()
    assert len(trials) == 6 and trials == TU.bootstrap_metrics(pred, weights, trials=6, seed=4).orderBy("trial").collect()
    summary = TU.bootstrap_summary(TU.bootstrap_metrics(pred, weights, trials=6, seed=4)).first()
    assert abs(summary.mean_rmse - np.mean([t.rmse for t in trials])) < 1e-12
    assert abs(summary.std_cum_recall - np.std([t.cum_recall for t in trials])) < 1e-12


def test_bundle_has_both_models(spark, table):
    train, test = table.filter("doc_id < 90"), table.filter("doc_id >= 90")
    tested, production = ridge().fit(train), ridge().fit(table)
    d = IO.scratch_dir(spark, "bundle")
    IO.save_bundle(d, tested, production, train, test, "rmse", 0.25, 0.5, val_df=test)
    for which, model in (("tested_model", tested), ("production_model", production)):
        got = {r.doc_id: r.prediction for r in IO.load_and_score(spark, d, test, which).collect()}
        assert got == {r.doc_id: r.prediction for r in model.transform(test).collect()}
    assert spark.read.parquet(f"{d}/train_data").count() == 90 and spark.read.parquet(f"{d}/validation_data").count() == 30
    info = spark.read.json(f"{d}/scores_and_info").first()
    assert (info.metric, info.train_score, info.test_score) == ("rmse", 0.25, 0.5)
    assert "RidgeRegression" in spark.read.text(f"{d}/tested_model_params", wholetext=True).first().value or \
        "LinearRegression" in spark.read.text(f"{d}/tested_model_params", wholetext=True).first().value


def test_naive_bayes_combination(spark):
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(6)
    rows = [(i, [math.log(rng.uniform(0.05, 1)) for _ in range(3)], [math.log(rng.uniform(0.05, 1)) for _ in range(3)]) for i in range(40)]
    prior = [math.log(x) for x in (0.5, 0.3, 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, x array<double>, y array<double>").select(
        "doc_id", array_to_vector("x").alias("x"), array_to_vector("y").alias("y"))
    got = {r.doc_id: r for r in M.combine_naive_bayes(M.combine_naive_bayes(df, "x", "y", prior), "x", "y", prior, 0.4, "cut").collect()}
    for i, x, y in rows:
        p = np.exp(np.array(x) + np.array(y) - np.array(prior))
        p /= p.sum()
        assert np.allclose(got[i].combined_probability, p)
        assert got[i].prediction == p.argmax() and got[i].cut == float(p[1] >= 0.4)


def test_token_weights(spark):
    from pyspark.ml.feature import CountVectorizer
    rows = [(i, ["alfa"] * (i % 2) + ["beta"] * (i % 3 == 0) + ["gama"], float(3 * (i % 2) - (i % 3 == 0))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>, relevancia double")
    stages = [CountVectorizer(inputCol="terms", outputCol="features")] + M.voting([RidgeRegression(alpha=0.01), M.forest().setMaxDepth(3)])
    got = {r.term: r for r in M.token_weights(Pipeline(stages=stages).fit(df), spark, IO.scratch_dir(spark, "weights")).collect()}
    assert set(got) == {"alfa", "beta", "gama"}
    assert abs(got["alfa"].weight - 3) < 0.1 and abs(got["beta"].weight + 1) < 0.1 and got["beta"].abs_weight > 0
    assert got["alfa"].importance > got["beta"].importance > got["gama"].importance - 1e-9


def test_features_fit_on_one_edition_type(spark):
    from gazrank.sources import tables
    from conftest import SF_SMALL
    rows = tables.articles(spark, SF_SMALL).filter("relevancia is not null and fulltext is not null").limit(40)
    one = rows.withColumn("edicao", F.lit("1"))
    model = Pipeline(stages=M.feature_stages(1)).fit(one)
    got = model.transform(one.limit(5).unionByName(rows.limit(5).withColumn("edicao", F.lit("1-A (extra)")))).select("features")
    assert got.count() == 10
