"""Ranking metrics: closed forms == the direct definitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from gazrank.operators import ranking as RK


def _cum_recall_direct(y, score, relevant=(4, 5)):
    order = sorted(range(len(y)), key=lambda i: (-score[i], i))
    y_sorted = np.array([y[i] for i in order])
    perfect = np.sort(np.array(y))[::-1]

    def frac(a):
        c = np.cumsum(np.isin(a, relevant).astype(int))
        return c / c[-1]
    a = frac(y_sorted).sum() / len(y)
    p = frac(perfect).sum() / len(y)
    return (a - 0.5) / (p - 0.5)


def _inversions(y, score):
    order = sorted(range(len(y)), key=lambda i: (score[i], i))
    r = [y[i] for i in order]
    return sum(max(0, r[i] - r[j]) for i in range(len(r)) for j in range(i + 1, len(r)))


def _df(spark, n=400, seed=5):
    rnd = random.Random(seed)
    y = [rnd.randint(1, 5) for _ in range(n)]
    s = [round(v + rnd.gauss(0, 1.5), 1) for v in y]      # many ties
    return y, s, spark.createDataFrame([(i, y[i], s[i]) for i in range(n)],
                                       "doc_id long, relevancia int, score double")


def test_cum_recall(spark):
    y, s, df = _df(spark)
    got = RK.cum_recall_metric(df).first()["cum_recall"]
    assert abs(got - _cum_recall_direct(y, s)) < 1e-12


def test_cum_recall_grouped_and_general_relevant(spark):
    y, s, df = _df(spark)
    d = df.withColumn("g", (F.col("doc_id") % 3).cast("int"))
    got = {r["g"]: r["cum_recall"] for r in RK.cum_recall_metric(d, relevant=(2, 3), group=["g"]).collect()}
    for g in range(3):
        idx = [i for i in range(len(y)) if i % 3 == g]
        want = _cum_recall_direct([y[i] for i in idx], [s[i] for i in idx], (2, 3))
        assert abs(got[g] - want) < 1e-12


def test_inversions(spark):
    y, s, df = _df(spark, n=200)
    r = RK.inversion_counts(df).first()
    assert r["inversions"] == _inversions(y, s)
    ys = sorted(y, reverse=True)
    mx = sum(max(0, ys[i] - ys[j]) for i in range(len(ys)) for j in range(i + 1, len(ys)))
    assert r["max_inversions"] == mx
