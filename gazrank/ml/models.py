"""Production models and simple predictors (MOD1-MOD12, MOD16, MOD17).

Both production models are one ``pyspark.ml.Pipeline``: preprocessing,
normalisation, n-grams, vocabulary, one-hot edition type, assembler and the
regressor(s).  Voting is two regressors writing their own prediction columns
plus a ``SQLTransformer`` averaging them, so the fitted model is a plain,
persistable ``PipelineModel``.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .sparse_forest import SparseForest, SparseForestModel
from .stages import (ArticlePreprocessor, NgramTokenizer, RidgeModel, RidgeRegression, SmoothIdf, TextRidge,
                     section_normalizer)

TEXT = "tit_org_ementa_text"
# No cap: CountVectorizer keeps min(this, number of terms), so every term that
# passes the document-frequency bounds is in the model.
VOCAB_SIZE = 2**31 - 1
# Columns that no fitted stage reads; left out of what is cached for a fit.
HEAVY_COLUMNS = ("fulltext", "ementa", "resumo", "identifica", "orgao", "assina", "cargo", "url", "url_certificado",
                 TEXT, "text_norm")


def feature_stages(section: int, binary: bool = True, use_idf: bool | None = None,
                   norm: str | None = None, bounds: bool = True) -> list:
    """Stages up to the ``features`` vector (VEC1/VEC2/VEC3 + VEC7 + VEC8)."""
    pre = ArticlePreprocessor(columns=["tipo_edicao", TEXT], fillna=K.NULL_TOKEN_SPACED)
    normz = section_normalizer(section, TEXT, "text_norm")
    if section == 1:
        grams = NgramTokenizer(inputCol="text_norm", outputCol="terms", nMin=1, nMax=2)
        cv = CountVectorizer(inputCol="terms", outputCol="tf", binary=binary, minDF=1.0,
                             vocabSize=VOCAB_SIZE)
        use_idf = True if use_idf is None else use_idf
    else:
        grams = NgramTokenizer(inputCol="text_norm", outputCol="terms", nMin=1, nMax=1)
        # CountVectorizer reads a maxDF of 1.0 as one document, so no bound means not to set it.
        limits = {"minDF": float(K.SECTION2_MIN_DF), "maxDF": K.SECTION2_MAX_DF} if bounds else {}
        cv = CountVectorizer(inputCol="terms", outputCol="tf", binary=binary, vocabSize=VOCAB_SIZE, **limits)
        use_idf = False if use_idf is None else use_idf
    stages = [pre, normz, grams, cv]
    vec = "tf"
    if use_idf:
        stages.append(SmoothIdf(inputCol="tf", outputCol="tfidf"))
        vec = "tfidf"
    if norm in ("l1", "l2"):
        stages.append(Normalizer(inputCol=vec, outputCol="tf_norm", p=1.0 if norm == "l1" else 2.0))
        vec = "tf_norm"
    stages += [edition_indicator(), VectorAssembler(inputCols=[vec, "tipo_vec"], outputCol="features")]
    return stages


def edition_indicator(input_col: str = "tipo_edicao", output_col: str = "tipo_vec") -> SQLTransformer:
    """VEC7: the edition type has two values (TXT1), so its one-hot vector without the first category is one
    number, 1 for an ordinary edition; nothing is fitted, and a part with one type is like any other."""
    return SQLTransformer(statement=f"SELECT *, CAST(coalesce({input_col} = 'Ordinária', false) AS DOUBLE) AS {output_col} "
                                    "FROM __THIS__")


def split_stateless(pipeline: Pipeline) -> tuple[list, list]:
    """Leading stages that need no fit (text preprocessing) and the rest."""
    stages = pipeline.getStages()
    i = 0
    while i < len(stages) and not isinstance(stages[i], Estimator):
        i += 1
    return stages[:i], stages[i:]


def light(df: DataFrame) -> DataFrame:
    """Without the text columns that the fitted stages do not read."""
    return df.drop(*HEAVY_COLUMNS)


def fit_cached(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit with the stateless prefix computed once and cached.

    Each estimator of a ``Pipeline`` re-reads its input; without a cache the
    text normaliser would run once per estimator pass.  The cache is dropped
    after the fit; the result is one ordinary ``PipelineModel``.
    """
    pre, rest = split_stateless(pipeline)
    pm = Pipeline(stages=pre).fit(df)
    x = light(pm.transform(df))
    if len(rest) == 1 and getattr(rest[0], "reads_once", False):
        return PipelineModel(pm.stages + [rest[0].fit(x)])
    x.persist()
    try:
        rm = Pipeline(stages=rest).fit(x)
    finally:
        x.unpersist()
    return PipelineModel(pm.stages + rm.stages)


def forest(prediction_col: str = "prediction", seed: int = 42, weight_col: str | None = None):
    """MOD2: 20 trees, depth 25, 70 % bootstrap, all features per split."""
    rf = RandomForestRegressor(featuresCol="features", labelCol="relevancia",
                               predictionCol=prediction_col, numTrees=K.FOREST_TREES,
                               maxDepth=K.FOREST_DEPTH, subsamplingRate=K.FOREST_SUBSAMPLE,
                               featureSubsetStrategy="all", minInstancesPerNode=1, seed=seed,
                               # execution settings only: more nodes split per data pass, node ids
                               # cached for deep trees (checkpointed every 10 iterations)
                               maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def sparse_forest(prediction_col: str = "prediction", seed: int = 42, weight_col: str | None = None) -> SparseForest:
    """MOD2 on the binary features of a text: the same forest, grown from their entries (:mod:`sparse_forest`)."""
    return SparseForest(predictionCol=prediction_col, seed=seed, weightCol=weight_col or "")


def sparse_tree(seed: int = 42) -> SparseForest:
    """MOD17's decision tree on binary features, as deep as MLlib's may be."""
    return SparseForest(numTrees=1, subsamplingRate=0.0, maxDepth=MAX_TREE_DEPTH, seed=seed)


def voting(regressors: list, prediction_col: str = "prediction") -> list:
    """MOD3: each regressor writes ``p_i``; the mean becomes the prediction."""
    cols = []
    for i, r in enumerate(regressors):
        c = f"p_vote_{i}"
        r.setPredictionCol(c) if hasattr(r, "setPredictionCol") else r._set(predictionCol=c)
        cols.append(c)
    mean = " + ".join(cols)
    sqlt = SQLTransformer(statement=f"SELECT *, ({mean}) / {float(len(cols))} AS {prediction_col} "
                                    "FROM __THIS__")
    return list(regressors) + [sqlt]


def section1_model(alpha: float = K.SECTION1_RIDGE_ALPHA, binary: bool = True, use_idf: bool = True, norm: str | None = None) -> Pipeline:
    """MOD4: binary TF-IDF of uni+bigrams (+1 idf, no norm) + one-hot edition
    type, ridge(10000); the terms are counted and weighted by the ridge's own stage."""
    return Pipeline(stages=feature_stages(1)[:3] + [edition_indicator(), TextRidge(
        alpha=alpha, binary=binary, useIdf=use_idf, norm=norm or "", keyCol=TEXT)])


def section2_model(alpha: float = K.SECTION2_RIDGE_ALPHA, seed: int = 42,
                   weight_col: str | None = None) -> Pipeline:
    """MOD5: binary unigrams (df 2 .. 0.7) + one-hot, vote of ridge(30) and
    the forest.  ``weight_col``: MOD6 instance weights."""
    ridge = RidgeRegression(alpha=alpha, weightCol=weight_col or "")
    return Pipeline(stages=feature_stages(2) + voting([ridge, sparse_forest(seed=seed, weight_col=weight_col)]))


def relevance_weight(label: str = "relevancia") -> Column:
    """MOD6: instance weight = label value."""
    return F.col(label).cast("double")


def bag_weights(df: DataFrame, n_estimators: int, max_samples: float = 1.0, seed: int = 42, bootstrap: bool = True,
                id_col: str = "doc_id", prefix: str = "bag_") -> DataFrame:
    """MOD17: ``df`` with one column of instance weights for each member of a bagged model.

    A weight is how often the member's sample has the row, so no row is copied. With
    ``bootstrap`` the sample is drawn with replacement (each draw keyed by its number, member and seed), else it is
    the first rows of a permutation keyed by the member: all rows, if ``max_samples`` is 1.
    """
    from ..operators.ordering import with_position
    spark = df.sparkSession
    pos = with_position(df.select(id_col), [id_col], name="_p")
    n = pos.count()
    take = max(1, int(max_samples * n))
    if bootstrap:
        draws = spark.range(n_estimators * take).select(
            F.floor(F.col("id") / take).alias("_m"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))) + 1).alias("_p"))
        counted = draws.groupBy("_p").agg(*[F.count(F.when(F.col("_m") == i, 1)).cast("double").alias(f"{prefix}{i}")
                                            for i in range(n_estimators)])
        weights = pos.join(counted, "_p", "left").na.fill(0.0).drop("_p")
    else:
        from ..operators.splits import shuffled_positions
        weights = pos.drop("_p")
        for i in range(n_estimators):
            weights = shuffled_positions(weights, id_col, seed + i, name="_q").withColumn(
                f"{prefix}{i}", (F.col("_q") <= take).cast("double")).drop("_q")
    return df.join(weights, id_col)


def bagged_ridge(n_estimators: int, alpha: float = K.SECTION2_RIDGE_ALPHA, prefix: str = "bag_", label: str = "relevancia") -> list:
    """MOD17: stages of a bagged ridge (members on :func:`bag_weights`' columns, then their mean); fits into a pipeline."""
    return voting([RidgeRegression(alpha=alpha, weightCol=f"{prefix}{i}", labelCol=label) for i in range(n_estimators)])


# MLlib's own limit; the reference's tree grows until its leaves are pure.
MAX_TREE_DEPTH = 30


def alternative_regressor(kind: str, alpha: float = 1.0, l1_ratio: float = 0.5, seed: int = 42):
    """MOD17: ElasticNet/Lasso, Huber, decision tree (commented candidates)."""
    if kind == "elasticnet":
        return LinearRegression(labelCol="relevancia", regParam=alpha, elasticNetParam=l1_ratio,
                                standardization=False)
    if kind == "huber":
        return LinearRegression(labelCol="relevancia", loss="huber", regParam=alpha, elasticNetParam=0.0)
    if kind == "tree":
        return DecisionTreeRegressor(labelCol="relevancia", maxDepth=MAX_TREE_DEPTH, seed=seed)
    raise ValueError(kind)


# ---------------------------------------------------------------- baselines


def constant_predictor(df: DataFrame, value: float, col: str = "prediction") -> DataFrame:
    """MOD7."""
    return df.withColumn(col, F.lit(float(value)))


def mode_of(df: DataFrame, label: str = "relevancia") -> float:
    """Most frequent label, smallest on ties (a one-row aggregate)."""
    return df.agg(F.mode(label, deterministic=True)).first()[0]


def keyed_uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def random_predictor(train: DataFrame, df: DataFrame, label: str = "relevancia",
                     follow_frequency: bool = False, seed: int = 42,
                     col: str = "prediction", id_col: str = "doc_id") -> DataFrame:
    """MOD8: uniform over the seen classes, or following their frequencies
    (inverse CDF over the class table, a handful of rows). The draw is keyed
    by the row's id, so it does not depend on partitions or retries."""
    counts = sorted((r[0], r[1]) for r in train.groupBy(label).count().collect())
    u = keyed_uniform(seed, F.col(id_col))
    if not follow_frequency:
        classes = F.array(*[F.lit(float(c)) for c, _ in counts])
        return df.withColumn(col, F.element_at(classes, (F.floor(u * len(counts)) + 1).cast("int")))
    total = float(sum(n for _, n in counts))
    expr, acc = None, 0.0
    for c, n in counts:
        acc += n / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(float(c))) if expr is None else expr.when(cond, F.lit(float(c)))
    return df.withColumn(col, expr.otherwise(F.lit(float(counts[-1][0]))))


def combine_naive_bayes(df: DataFrame, raw1: str, raw2: str, log_prior: list[float],
                        threshold: float | None = None, out: str = "prediction") -> DataFrame:
    """MOD11: two Naive Bayes models (MLlib ``rawPrediction`` = log joint):
    ``p ~ exp(l1 + l2 - log prior)``, normalised by log-sum-exp; argmax, or
    class 1 when ``p[1] >= threshold``."""
    from pyspark.ml.functions import vector_to_array
    l1, l2 = vector_to_array(F.col(raw1)), vector_to_array(F.col(raw2))
    prior = F.array(*[F.lit(float(v)) for v in log_prior])
    s = F.zip_with(F.zip_with(l1, l2, lambda a, b: a + b), prior, lambda a, b: a - b)
    mx = F.array_max(s)
    lse = mx + F.log(F.aggregate(F.transform(s, lambda v: F.exp(v - mx)), F.lit(0.0), lambda a, b: a + b))
    prob = F.transform(s, lambda v: F.exp(v - lse))
    d = df.withColumn("combined_probability", prob)
    if threshold is None:
        pred = F.array_position(prob, F.array_max(prob)) - 1
    else:
        pred = F.when(F.element_at(prob, 2) >= threshold, F.lit(1)).otherwise(F.lit(0))
    return d.withColumn(out, pred.cast("double"))


def stage_table(spark, model, kind, column: str, name: str, path: str) -> DataFrame:
    """``(idx, name)`` of an array or vector that a fitted stage holds, read from the stage's saved files.

    The stage writes them itself, so a large vocabulary or coefficient vector is
    not looped over in the driver.
    """
    from pyspark.ml.functions import vector_to_array
    stage = next((s for s in model.stages if isinstance(s, kind)), None)
    if stage is None:
        return None
    stage.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    values = F.col(column) if data.schema[column].dataType.typeName() == "array" else vector_to_array(F.col(column))
    return data.select(F.posexplode(values).alias("idx", name))


def token_weights(model, spark, path: str) -> DataFrame:
    """MOD16: vocabulary x ridge coefficients x forest importances; the
    one-hot coefficient (last) is excluded.  ``path``: scratch folder."""
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.regression import RandomForestRegressionModel
    out = stage_table(spark, model, CountVectorizerModel, "vocabulary", "term", f"{path}/vocabulary")
    coef = stage_table(spark, model, RidgeModel, "coefficients", "weight", f"{path}/ridge")
    rf = next((s for s in model.stages if isinstance(s, RandomForestRegressionModel)), None)
    if coef is not None:
        out = out.join(coef, "idx", "left")
    else:
        out = out.withColumn("weight", F.lit(None).cast("double"))
    sparse = next((s for s in model.stages if isinstance(s, SparseForestModel)), None)
    if sparse is not None:
        out = out.join(sparse.importances(), "idx", "left").na.fill(0.0, ["importance"])
    elif rf is not None:
        # sparse: at most one entry for each split of the trees
        imp = rf.featureImportances
        imp = list(zip(map(int, imp.indices), map(float, imp.values)))
        out = out.join(spark.createDataFrame(imp, "idx int, importance double"), "idx", "left").na.fill(0.0, ["importance"])
    else:
        out = out.withColumn("importance", F.lit(None).cast("double"))
    return out.select("term", "weight", "importance", F.abs("weight").alias("abs_weight"))


def hard_vote(labels: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """MOD10 vote: most frequent label per id, smallest on ties."""
    c = labels.groupBy(id_col, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(id_col).orderBy(F.col("_n").desc(), F.col(label).asc())
    return (c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select(id_col, F.col(label).alias("vote")))


def column_selector(columns: list[str], make_stage=None, output_col: str = "features") -> list:
    """PRJ5: one stage per column (``make_stage(col) -> stage`` writing
    ``<col>_vec``), or the columns passed through as they are, assembled
    into one vector."""
    if make_stage is None:
        return [VectorAssembler(inputCols=list(columns), outputCol=output_col)]
    stages = [make_stage(c) for c in columns]
    return stages + [VectorAssembler(inputCols=[f"{c}_vec" for c in columns], outputCol=output_col)]
