"""Clustering, voting, keyed samples and the unbounded vocabulary against plain Python."""

import math

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gazrank.ml import cluster as CL
from gazrank.ml import models as M
from gazrank.ml import tuning as TU


def _tables(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    x[5] = 0.0
    c = rng.random((7, 6)) * (rng.random((7, 6)) < 0.5)
    rows = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    entries = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(40) for d in range(6) if x[i, d]],
                                    "doc_id long, dim int, value double")
    centres = spark.createDataFrame([(j, d, float(c[j, d])) for j in range(7) for d in range(6) if c[j, d]],
                                    "centre int, dim int, cvalue double")
    return x, c, rows, entries, centres


def test_distances_and_representatives(spark):
    x, c, rows, entries, centres = _tables(spark)
    d = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(axis=2))
    own = rows.withColumn("centre", (F.col("doc_id") % 7).cast("int"))
    for r in CL.own_distances(own, entries, centres).collect():
        assert math.isclose(r.distance, d[r.doc_id, r.centre], abs_tol=1e-9)
    got = {r.centre: r.distance for r in CL.representatives(rows, entries, centres).collect()}
    for j in got:
        assert math.isclose(got[j], d[:, j].min(), abs_tol=1e-9)
    for r in CL.member_profiles(own, entries, centres).collect():
        members = x[[i for i in range(40) if i % 7 == r.cluster]]
        assert math.isclose(r.member_mean, members[:, r.dim].mean(), abs_tol=1e-9)
        assert math.isclose(r.centre_value, c[r.cluster, r.dim], abs_tol=1e-9)


def test_votes_of_aligned_clusters(spark):
    rng = np.random.default_rng(5)
    points = [(i, Vectors.dense((np.array([10.0 * (i % 3), 5.0 * (i % 3)]) + rng.normal(0, 0.1, 2)).tolist())) for i in range(60)]
    features = spark.createDataFrame(points, ["doc_id", "features"])
    vote = {r.doc_id: r.vote for r in CL.bagged_kmeans_vote(features, 4, 3, 0.7, 1).collect()}
    assert len({(i % 3, v) for i, v in vote.items()}) == 3  # one number for each true group


def test_bag_samples_are_exact_and_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r.doc_id for r in TU.bag_samples(d, 1, 0.7, 4)[0].collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 70 and len(set(a)) < 70
    assert TU.bag_samples(df, 1, 1000, 4)[0].count() == 100


def test_random_predictor_is_keyed(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(200)], "doc_id long, relevancia int")
    a, b = ({r.doc_id: r.prediction for r in M.random_predictor(df, d, seed=3).collect()} for d in (df, df.repartition(5)))
    assert a == b and len(set(a.values())) == 5


def test_no_term_is_dropped(spark):
    from pyspark.ml.feature import CountVectorizer
    df = spark.createDataFrame([([f"t{i}" for i in range(3000)],)], "terms array<string>")
    m = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=M.VOCAB_SIZE).fit(df)
    assert len(m.vocabulary) == 3000
    assert M.VOCAB_SIZE == 2**31 - 1


def test_kmeans_rests(spark):
    rng = np.random.default_rng(11)
    x = (rng.random((300, 40)) < 0.2).astype(float)
    x[7] = 0.0
    x[20:40] = x[20]  # copies
    size = 2**31 - 1  # no vector of this length fits anywhere
    at = [d * 50_000_000 for d in range(40)]
    rows = [(i, Vectors.sparse(size, [(at[d], 1.0) for d in range(40) if x[i, d]])) for i in range(300)]
    fitted = CL.fit_kmeans(spark.createDataFrame(rows, ["doc_id", "features"]), 9, 1)
    own = {r.doc_id: r.cluster for r in fitted.labels().collect()}
    label = np.array([own[i] for i in range(300)])
    centres = np.array([x[label == j].mean(axis=0) for j in range(9)])
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (d[np.arange(300), label] <= d.min(axis=1) + 1e-9).all()
    got = np.zeros_like(centres)
    for r in CL.centre_table(fitted).collect():
        got[r.centre, at.index(r.dim)] = r.cvalue
    assert np.allclose(got, centres)


def test_kmeans_with_few_rows(spark):
    rows = [(i, Vectors.dense([float(i % 3), 1.0])) for i in range(12)]
    fitted = CL.fit_kmeans(spark.createDataFrame(rows, ["doc_id", "features"]), 5, 1)
    groups = {(r.doc_id % 3, r.cluster) for r in fitted.labels().collect()}
    assert len(groups) == 3 and fitted.centres.k == 3


def test_entries_of_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"], 1.0), (2, ["b"], 0.0), (3, ["c", "a", "b"], 1.0), (4, [], 0.0)],
                                 "doc_id long, terms array<string>, edition double")
    got = sorted((r.doc_id, r.dim, r.value) for r in CL.sparse_entries(rows).collect())
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (1, 3, 1.0), (2, 0, 1.0), (3, 0, 1.0), (3, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0)]
