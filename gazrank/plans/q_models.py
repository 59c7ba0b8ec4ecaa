"""Registered queries: models, clustering, evaluation and tuning (MOD*, EVA*,
SPL9, SPL10, SNK2, SRC3).

Model fits are randomised or iterative, so most entries are rows-only
checks (no SQL oracle); the properties are tested in ``tests/``.  Entries
over deterministic inputs (voting mean, constant baseline, evaluator) have
oracles.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from .. import constants as K
from ..ml import cluster as CL
from ..ml import kmeans as KM
from ..ml import models as M
from ..ml import tuning as TU
from ..ml.stages import RidgeRegression
from ..operators import ranking as RK
from ..sources import io as IO
from ..sources import tables
from ..operators import cuts
from ..session import materialize
from .common import SQL_SCORE, articles, score, splits, sql
from .registry import register


def _parts(spark, sf):
    s = splits(spark, sf)
    return (s, s.filter(F.col("split") == "train"), s.filter(F.col("split") == "val"),
            s.filter(F.col("split") == "test"))


def _split_scores(pred):
    # scored once; both metrics read the result
    pred = materialize(pred.select("doc_id", "split", "relevancia", "prediction"))
    r = pred.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.sqrt(F.avg(F.pow(F.col("relevancia") - F.col("prediction"), 2))), 6).alias("rmse"))
    cr = RK.cum_recall_metric(pred, score="prediction", group=["split"]).select(
        "split", F.round("cum_recall", 6).alias("cum_recall"))
    return r.join(cr, "split")


@register("mod1_ridge_section1_predictions")
def mod1(spark, sf):
    """MOD1/MOD4: section-1 pipeline (binary TF-IDF uni+bigrams, ridge 10000)
    fitted on train, predictions for validation and test."""
    s, tr, va, te = _parts(spark, sf)
    m = M.fit_cached(M.section1_model(), tr)
    return m.transform(va.unionByName(te)).select("doc_id", "split", "relevancia",
                                                 F.round("prediction", 6).alias("prediction"))


@register("mod4_section1_split_scores")
def mod4(spark, sf):
    """EVA11 for MOD4: RMSE and cumulative recall per split."""
    s, tr, _, _ = _parts(spark, sf)
    return _split_scores(M.fit_cached(M.section1_model(), tr).transform(s))


@register("mod5_section2_split_scores")
def mod5(spark, sf):
    """EVA11 for MOD5: vote of ridge(30) and the forest, per split."""
    s, tr, _, _ = _parts(spark, sf)
    return _split_scores(M.fit_cached(M.section2_model(), tr).transform(s))


@register("mod2_forest_predictions")
def mod2(spark, sf):
    """MOD2: the forest alone on the section-2 features."""
    s, tr, va, _ = _parts(spark, sf)
    p = M.fit_cached(Pipeline(stages=M.feature_stages(2) + [M.sparse_forest()]), tr)
    return p.transform(va).select("doc_id", "relevancia", F.round("prediction", 6).alias("prediction"))


@register("mod6_weighted_section2_scores")
def mod6(spark, sf):
    """MOD6: section-2 model with instance weight = label."""
    s, tr, _, _ = _parts(spark, sf)
    w = "w"
    m = M.fit_cached(M.section2_model(weight_col=w), tr.withColumn(w, M.relevance_weight()))
    return _split_scores(m.transform(s.withColumn(w, M.relevance_weight())))


_P2 = "(relevancia * 0.8 + 0.5)"


@register("mod3_voting_mean",
          lambda: sql(f"SELECT doc_id, round(({SQL_SCORE} + {_P2}) / 2.0, 6) AS prediction FROM splits"))
def mod3(spark, sf):
    """MOD3 on given member predictions: the vote is their mean."""
    s = splits(spark, sf).select("doc_id", score().alias("p_vote_0"),
                                 (F.col("relevancia") * 0.8 + 0.5).alias("p_vote_1"))
    vote = SQLTransformer(statement="SELECT *, (p_vote_0 + p_vote_1) / 2.0 AS prediction FROM __THIS__")
    return vote.transform(s).select("doc_id", F.round("prediction", 6).alias("prediction"))


@register("mod7_constant_baseline",
          lambda: sql("SELECT doc_id, CAST((SELECT relevancia FROM splits WHERE split = 'train' "
                      "GROUP BY relevancia ORDER BY count(*) DESC, relevancia LIMIT 1) AS DOUBLE) AS prediction "
                      "FROM splits WHERE split = 'val'"))
def mod7(spark, sf):
    """MOD7: constant predictor = most frequent train label (smallest on ties)."""
    s, tr, va, _ = _parts(spark, sf)
    return M.constant_predictor(va, M.mode_of(tr)).select("doc_id", "prediction")


@register("mod8_random_baselines")
def mod8(spark, sf):
    """MOD8: uniform and frequency-following random predictors."""
    s, tr, va, _ = _parts(spark, sf)
    u = M.random_predictor(tr, va, seed=1).select("doc_id", F.col("prediction").alias("uniform"))
    f = M.random_predictor(tr, va, follow_frequency=True, seed=2).select(
        "doc_id", F.col("prediction").alias("frequency"))
    return u.join(f, "doc_id")


@register("mod9_best_baseline")
def mod9(spark, sf):
    """MOD9: constant / uniform / frequency baselines by 5-fold CV RMSE."""
    _, tr, _, _ = _parts(spark, sf)
    return TU.baseline_random(tr, k=5)


@register("mod11_naive_bayes_combination")
def mod11(spark, sf):
    """MOD11: multinomial NB on word counts x Gaussian NB on numeric
    features, combined through their log posteriors."""
    s, tr, va, _ = _parts(spark, sf)
    feats = M.fit_cached(Pipeline(stages=M.feature_stages(2)), tr)
    prep = lambda d: feats.transform(d).withColumn(
        "y", F.col("relevancia").isin(*K.RELEVANT_LABELS).cast("double")).withColumn(
        "len_log", F.log10(1 + F.length("fulltext").cast("double"))).withColumn(
        "n_lev", F.size(F.split(F.coalesce("orgao", F.lit("")), "/")).cast("double"))
    ftr, fva = prep(tr), prep(va)
    num = VectorAssembler(inputCols=["len_log", "n_lev"], outputCol="num")
    ftr, fva = num.transform(ftr), num.transform(fva)
    nb1 = NaiveBayes(featuresCol="tf", labelCol="y", modelType="multinomial",
                     rawPredictionCol="raw1", probabilityCol="pr1", predictionCol="pd1").fit(ftr)
    nb2 = NaiveBayes(featuresCol="num", labelCol="y", modelType="gaussian",
                     rawPredictionCol="raw2", probabilityCol="pr2", predictionCol="pd2").fit(ftr)
    out = nb2.transform(nb1.transform(fva))
    prior = list(nb1.pi.toArray())
    comb = M.combine_naive_bayes(out, "raw1", "raw2", prior)
    return comb.select("doc_id", "relevancia", "prediction")


@register("mod12_prediction_as_feature")
def mod12(spark, sf):
    """MOD12: the ridge prediction used as a feature of a forest."""
    s, tr, va, _ = _parts(spark, sf)
    stages = M.feature_stages(2) + [
        RidgeRegression(alpha=K.SECTION2_RIDGE_ALPHA, predictionCol="ridge_pred"),
        VectorAssembler(inputCols=["ridge_pred", "tipo_vec"], outputCol="stack"),
        M.forest().setFeaturesCol("stack")]
    return M.fit_cached(Pipeline(stages=stages), tr).transform(va).select(
        "doc_id", F.round("ridge_pred", 6).alias("ridge_pred"), F.round("prediction", 6).alias("prediction"))


def _pool_rows(spark, sf):
    """The pool that passes its cut, with every term of the text as a feature: the rows, their entries and both as tiles."""
    pool = tables.pool(articles(spark, sf)).filter(cuts.pool_cut()).filter(F.col("fulltext").isNotNull())
    # the edition type as one 0/1 column, also where only one type occurs
    extra = SQLTransformer(statement="SELECT *, CAST(tipo_edicao <> 'Extra' AS DOUBLE) AS edition FROM __THIS__")
    fm = Pipeline(stages=M.feature_stages(2, bounds=False)[:3] + [extra]).fit(pool)
    rows = materialize(fm.transform(pool).select("doc_id", "terms", "edition"))
    entries = materialize(CL.sparse_entries(rows))
    return entries, KM.tiled(rows.select("doc_id"), entries)


def _clusters(spark, sf):
    entries, data = _pool_rows(spark, sf)
    km = CL.fit_kmeans(data, K.KMEANS_K)
    return materialize(km.labels("centre")), entries, materialize(CL.centre_table(km))


@register("mod13_kmeans_pool")
def mod13(spark, sf):
    """MOD13: k-means (k = 100) on the unlabelled pool; each document's
    cluster and its distance to that centre, the nearest."""
    own, entries, centres = _clusters(spark, sf)
    return CL.own_distances(own, entries, centres).select(
        "doc_id", F.col("centre").alias("cluster"), F.round("distance", 6).alias("distance"))


@register("mod14_cluster_representatives")
def mod14(spark, sf):
    """MOD14: per centre, the nearest pool document (over all documents)."""
    own, entries, centres = _clusters(spark, sf)
    return CL.representatives(own.select("doc_id"), entries, centres).select(
        "centre", "doc_id", F.round("distance", 6).alias("distance"))


@register("mod15_cluster_profile")
def mod15(spark, sf):
    """MOD15: centre vs mean member vector of every cluster."""
    own, entries, centres = _clusters(spark, sf)
    return CL.member_profiles(own, entries, centres)


@register("mod10_bagged_kmeans_vote")
def mod10(spark, sf):
    """MOD10: bagged k-means members, centres aligned, with a hard vote."""
    return CL.bagged_kmeans_vote(_pool_rows(spark, sf)[1], n_estimators=4, k=5)


@register("mod16_token_weights")
def mod16(spark, sf):
    """MOD16: vocabulary x ridge coefficient x forest importance."""
    _, tr, _, _ = _parts(spark, sf)
    m = M.fit_cached(M.section2_model(), tr)
    return M.token_weights(m, spark, IO.scratch_dir(spark, "weights"))


BAG_MEMBERS = 5


@register("mod17_alternative_regressors")
def mod17(spark, sf):
    """MOD17: elastic net, Huber, a decision tree and a bagged ridge on section-2 features."""
    s, tr, va, _ = _parts(spark, sf)
    fm = M.fit_cached(Pipeline(stages=M.feature_stages(2)), tr)
    ftr, fva = (materialize(M.light(fm.transform(x)).select("doc_id", "relevancia", "features")) for x in (tr, va))
    bagged = Pipeline(stages=M.bagged_ridge(BAG_MEMBERS)).fit(M.bag_weights(ftr, BAG_MEMBERS))
    rows = [("bagged_ridge", TU.rmse(bagged.transform(fva)))]
    for kind, a in (("elasticnet", 0.023), ("huber", 0.01), ("tree", 0.0)):
        m = (M.sparse_tree() if kind == "tree" else M.alternative_regressor(kind, alpha=a)).fit(ftr)
        rows.append((kind, TU.rmse(m.transform(fva))))
    return spark.createDataFrame(rows, "model string, val_rmse double")


# ---------------------------------------------------------------- EVA


@register("eva1_cv_rmse")
def eva1(spark, sf):
    """EVA1-EVA3: 5-fold CV RMSE on held-out folds, on training folds and
    with permuted labels (mean and population std)."""
    _, tr, _, _ = _parts(spark, sf)
    got = TU.text_cv_scores(M.section1_model(), tr, k=5, permute_seed=7)
    kinds = (("held_out", got["held_out"][0]), ("train", got["held_out"][1]), ("permuted", got["permuted"][0]))
    rows = [(name, *TU.mean_std(scores)) for name, scores in kinds]
    return spark.createDataFrame(rows, "kind string, mean_rmse double, std_rmse double")


@register("eva4_oof_predictions")
def eva4(spark, sf):
    """EVA4: out-of-fold predictions (shuffle seed 3911); each id once."""
    _, tr, _, _ = _parts(spark, sf)
    return TU.cross_val_predict(M.section2_model(), tr, k=5)


@register("eva5_learning_curve")
def eva5(spark, sf):
    """EVA5: nested training prefixes, cumulative recall on train / val."""
    _, tr, va, _ = _parts(spark, sf)
    return TU.learning_curve(M.section1_model(), tr, va)


@register("eva6_cv_learning_curve")
def eva6(spark, sf):
    """EVA6: CV score per training fraction, with the band of random predictions."""
    _, tr, _, _ = _parts(spark, sf)
    return TU.cv_learning_curve(M.section1_model(), tr)


@register("eva7_grid_search")
def eva7(spark, sf):
    """EVA7: 6 alphas x binary x idf x 3 norms on the fixed validation split."""
    _, tr, va, _ = _parts(spark, sf)
    return TU.search_fixed_split(spark, tr, va, TU.grid(TU.SECTION1_GRID), section=1)


def _decisions(spark, sf):
    """Out-of-fold decision values (3 folds) of a linear classifier of relevance on the section-2 features."""
    _, tr, _, _ = _parts(spark, sf)
    labelled = tr.withColumn("y", F.col("relevancia").isin(*K.RELEVANT_LABELS).cast("double"))
    classifier = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.1, elasticNetParam=0.0, maxIter=50)
    return TU.cross_val_decisions(Pipeline(stages=M.feature_stages(2) + [classifier]), labelled)


@register("win9_decision_curve")
def win9_decisions(spark, sf):
    """WIN9: precision, recall and false-positive rate at each out-of-fold decision value."""
    c = RK.threshold_curve(_decisions(spark, sf), score="decision")
    return c.select(F.round("threshold", 6).alias("threshold"), "tp", "fp",
                    *[F.round(x, 6).alias(x) for x in ("precision", "recall", "fpr")])


@register("win10_decision_roc_point")
def win10_decisions(spark, sf):
    """WIN10: the ROC point of the decision value nearest to the default threshold, 0."""
    c = RK.threshold_curve(_decisions(spark, sf), score="decision")
    return c.orderBy(F.abs("threshold"), F.col("threshold").desc()).limit(1).select(
        F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("recall", 6).alias("tpr"))


@register("eva3_label_permutation",
          lambda: sql("SELECT i.doc_id, s.relevancia AS permuted FROM "
                      "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM splits WHERE split = 'train') i JOIN "
                      "(SELECT relevancia, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS p "
                      "FROM splits WHERE split = 'train') s ON i.p = s.p"))
def eva3_permutation(spark, sf):
    """EVA3: the labels of the noise floor, a seeded permutation of the training labels."""
    _, tr, _, _ = _parts(spark, sf)
    return TU.permute_labels(tr, 7).select("doc_id", F.col("relevancia").alias("permuted"))


_NB = ("ln(0.2 + (doc_id % 7) / 10.0)", "ln(0.3 + (doc_id % 5) / 10.0)", "ln(0.9 - (doc_id % 3) / 10.0)", "ln(0.25 + (doc_id % 11) / 20.0)")


@register("mod11_combined_posterior",
          lambda: sql("SELECT doc_id, round(1.0 / (1.0 + exp(a - b)), 6) AS p1, CASE WHEN b > a THEN 1.0 ELSE 0.0 END AS prediction, "
                      "CASE WHEN 1.0 / (1.0 + exp(a - b)) >= 0.31234 THEN 1.0 ELSE 0.0 END AS at_threshold FROM (SELECT doc_id, "
                      f"{_NB[0]} + {_NB[2]} - ln(0.6) AS a, {_NB[1]} + {_NB[3]} - ln(0.4) AS b FROM splits)"))
def mod11_posterior(spark, sf):
    """MOD11 on given log probabilities: combined posterior, its argmax and its threshold form."""
    from pyspark.ml.functions import array_to_vector
    raw = splits(spark, sf).select("doc_id", *[array_to_vector(F.array(F.expr(x), F.expr(y))).alias(n)
                                               for n, x, y in (("r1", _NB[0], _NB[1]), ("r2", _NB[2], _NB[3]))])
    prior = [math.log(0.6), math.log(0.4)]
    c = M.combine_naive_bayes(raw, "r1", "r2", prior)
    c = M.combine_naive_bayes(c, "r1", "r2", prior, threshold=0.31234, out="at_threshold")
    return c.select("doc_id", F.round(F.element_at("combined_probability", 2), 6).alias("p1"), "prediction", "at_threshold")


_RESULT_SCORES = {"mean_test_score": "val", "mean_train_score": "train"}


def result_table(spark, sf):
    """A search-result table with the columns of EVA7, taken from the articles: a candidate is
    a section and a class, its scores are the mean stand-in scores of its rows per split."""
    s = splits(spark, sf).withColumn("score", score())
    return s.groupBy(F.col("secao").alias("param_secao"), F.col("relevancia").alias("param_class")).agg(
        *[F.round(F.coalesce(F.avg(F.when(F.col("split") == v, F.col("score"))), F.lit(0.0)), 6).alias(n)
          for n, v in _RESULT_SCORES.items()],
        F.count(F.lit(1)).cast("double").alias("mean_fit_time"))


_SQL_RESULTS = ("results AS (SELECT secao AS param_secao, relevancia AS param_class, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN split = '{v}' THEN score END), 0.0), 6) AS {n}" for n, v in _RESULT_SCORES.items())
    + ", CAST(count(*) AS DOUBLE) AS mean_fit_time FROM scored GROUP BY 1, 2)")


@register("eva9_search_table",
          lambda: sql("SELECT * FROM results ORDER BY mean_test_score DESC, mean_fit_time, mean_train_score DESC LIMIT 10",
                      _SQL_RESULTS))
def eva9(spark, sf):
    """EVA9 + TOP5: search results, best first, top 10."""
    return TU.search_table(result_table(spark, sf)).limit(10)


@register("eva10_param_slices",
          lambda: sql("SELECT r.*, 'param_secao' AS varied_param FROM results r, best WHERE r.param_class = best.param_class "
                      "UNION ALL SELECT r.*, 'param_class' FROM results r, best WHERE r.param_secao = best.param_secao",
                      _SQL_RESULTS + ", best AS (SELECT * FROM results ORDER BY mean_test_score DESC LIMIT 1)"))
def eva10(spark, sf):
    """EVA10: per parameter, candidates with all other parameters at best."""
    return TU.best_param_slices(result_table(spark, sf), ["param_secao", "param_class"])


SEARCH_COLUMNS = ["titulo", "orgao", "ementa", "fulltext"]


@register("eva8_random_search")
def eva8(spark, sf):
    """EVA8: random search over integer weights of the four text columns (20 vectors), their
    combination and the penalty; one table of counts for all candidates."""
    _, tr, va, _ = _parts(spark, sf)
    params = {"alpha": [K.SECTION2_RIDGE_ALPHA, 300.0], "binary": [True, False], "agg": ["max", "sum"],
              "weights": TU.weight_vectors(len(SEARCH_COLUMNS)), "columns": [SEARCH_COLUMNS]}
    return TU.search_fixed_split(spark, tr, va, TU.random_candidates(params, 40), section=2)


@register("eva12_cum_recall_evaluator",
          lambda: sql("SELECT round((s / (r * n) - 0.5) / (sp / (r * n) - 0.5), 6) AS cum_recall FROM "
                      "(SELECT count(*) AS n, count_if(relevancia IN (4, 5)) AS r, "
                      "sum(CASE WHEN relevancia IN (4, 5) THEN n0 - pos + 1 END) AS s, "
                      "sum(CASE WHEN relevancia IN (4, 5) THEN n0 - ppos + 1 END) AS sp FROM "
                      "(SELECT relevancia, count(*) OVER () AS n0, "
                      "row_number() OVER (ORDER BY score DESC, doc_id) AS pos, "
                      "row_number() OVER (ORDER BY relevancia DESC, doc_id) AS ppos FROM scored "
                      "WHERE split = 'val'))"))
def eva12(spark, sf):
    """EVA12: the evaluator on a deterministic score of the validation split."""
    va = splits(spark, sf).filter(F.col("split") == "val").withColumn("prediction", score())
    v = TU.CumRecallEvaluator().evaluate(va)
    return spark.createDataFrame([(round(v, 6),)], "cum_recall double")


@register("spl9_bootstrap_trials")
def spl9(spark, sf):
    """SPL9: class-rebalanced weighted bootstrap, 10 trials, on the
    deterministic score of the validation split."""
    from .q_relational import class_weights
    val, w = class_weights(spark, sf)
    pred = val.withColumn("prediction", score())
    return TU.bootstrap_metrics(pred, w, trials=K.BOOTSTRAP_TRIALS, seed=42)


@register("spl9_bootstrap_summary")
def spl9_summary(spark, sf):
    """SPL9: mean and std over the trials, cumulative recall square-rooted."""
    from .q_relational import class_weights
    val, w = class_weights(spark, sf)
    pred = val.withColumn("prediction", score())
    return TU.bootstrap_summary(TU.bootstrap_metrics(pred, w, trials=K.BOOTSTRAP_TRIALS, seed=42, sqrt_recall=True))


@register("spl10_bag_samples")
def spl10(spark, sf):
    """SPL10: bootstrap subsample sizes of 4 bagging members (seed + i)."""
    _, tr, _, _ = _parts(spark, sf)
    rows = [(i, s.count()) for i, s in enumerate(TU.bag_samples(tr, 4, 0.7, 42))]
    return spark.createDataFrame(rows, "member int, n_rows long")


@register("snk2_src3_model_bundle")
def bundle(spark, sf):
    """SNK2 + SRC3: save a model bundle (models, samples, params, scores),
    load the tested model back and score the test split."""
    s, tr, va, te = _parts(spark, sf)
    m = M.fit_cached(M.section2_model(), tr)
    ev = TU.CumRecallEvaluator()
    d = IO.scratch_dir(spark, "bundle")
    IO.save_bundle(d, m, None, tr, te, "cum_recall", ev.evaluate(m.transform(tr)),
                   ev.evaluate(m.transform(te)), val_df=va)
    return IO.load_and_score(spark, d, te).select("doc_id", F.round("prediction", 6).alias("prediction"))


@register("snk2_production_model")
def production_bundle(spark, sf):
    """EVA11 + SNK2: the section-1 model tested on its splits, fitted again on all rows for production,
    both saved in one bundle; the production model is loaded back and scores the unlabelled pool."""
    s, tr, va, te = _parts(spark, sf)
    tested, production = M.fit_cached(M.section1_model(), tr), M.fit_cached(M.section1_model(), s)
    scores = TU.grouped_scores([tested.transform(tr), tested.transform(te)], "cum_recall")
    d = IO.scratch_dir(spark, "production")
    IO.save_bundle(d, tested, production, tr, te, "cum_recall", *scores, val_df=va)
    pool = tables.pool(articles(spark, sf)).filter(cuts.pool_cut()).filter(F.col("fulltext").isNotNull())
    return IO.load_and_score(spark, d, pool, "production_model").select("doc_id", F.round("prediction", 6).alias("prediction"))


@register("prj5_column_selector",
          lambda: sql("SELECT doc_id, CAST(relevancia AS DOUBLE) AS passed, CASE WHEN relevancia > 2 THEN 1.0 ELSE 0.0 END AS b_label, "
                      "CASE WHEN doc_id % 9 > 2 THEN 1.0 ELSE 0.0 END AS b_rest FROM splits"))
def prj5(spark, sf):
    """PRJ5: columns passed through, and one stage for each column, as vectors."""
    from pyspark.ml.feature import Binarizer
    from pyspark.ml.functions import vector_to_array
    s = splits(spark, sf).select("doc_id", F.col("relevancia").cast("double").alias("label"), (F.col("doc_id") % 9).cast("double").alias("rest"))
    stages = M.column_selector(["label"], output_col="plain") + M.column_selector(
        ["label", "rest"], lambda c: Binarizer(inputCol=c, outputCol=f"{c}_vec", threshold=2.0), "stages")
    out = Pipeline(stages=stages).fit(s).transform(s)
    plain, both = vector_to_array("plain"), vector_to_array("stages")
    return out.select("doc_id", F.get(plain, F.lit(0)).alias("passed"), F.get(both, F.lit(0)).alias("b_label"), F.get(both, F.lit(1)).alias("b_rest"))


@register("mod10_vote_of_given_labels",
          lambda: sql("SELECT doc_id, vote FROM (SELECT doc_id, label AS vote, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, "
                      "label) AS r FROM (SELECT doc_id, unnest([doc_id % 3, doc_id % 4, doc_id % 5, (doc_id * 7) % 3]) AS label FROM splits) "
                      "GROUP BY doc_id, label) WHERE r = 1"))
def mod10_vote(spark, sf):
    """MOD10: the hard vote on given member labels (smallest label on ties)."""
    d = F.col("doc_id")
    labels = splits(spark, sf).select("doc_id", F.explode(F.array(d % 3, d % 4, d % 5, (d * 7) % 3)).alias("label"))
    return M.hard_vote(labels, "doc_id", "label")


@register("mod14_nearest_of_given_centres",
          lambda: sql("SELECT centre, doc_id, round(sqrt(q), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY q, doc_id) "
                      "AS r FROM (SELECT centre, doc_id, sum(power((doc_id * (dim + 3)) % 5 - ((centre + 1) * (dim + 2)) % 4, 2)) AS q FROM "
                      "(SELECT doc_id FROM splits), (SELECT range AS centre FROM range(4)), (SELECT range AS dim FROM range(6)) GROUP BY 1, 2)) "
                      "WHERE r = 1"))
def mod14_given(spark, sf):
    """MOD14 on given vectors: the nearest document of each centre (smallest id on ties)."""
    s = splits(spark, sf).select("doc_id")
    dims = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("dim")
    entries = s.select("doc_id", dims).select("doc_id", "dim", ((F.col("doc_id") * (F.col("dim") + 3)) % 5).cast("double").alias("value"))
    centres = spark.range(4).select(F.col("id").cast("int").alias("centre"), dims).select(
        "centre", "dim", (((F.col("centre") + 1) * (F.col("dim") + 2)) % 4).cast("double").alias("cvalue"))
    out = CL.representatives(s, entries.filter("value <> 0"), centres.filter("cvalue <> 0 or dim = 0"))
    return out.select(F.col("centre").cast("bigint").alias("centre"), "doc_id", F.round("distance", 6).alias("distance"))
