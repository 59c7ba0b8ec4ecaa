"""MLlib stages (EXT1): article preprocessing, text normalisation, n-grams,
smooth IDF and ridge regression with the reference's penalty.

All stages are ``pyspark.ml`` Transformers/Estimators with ``Param``s and
default persistence, so fitted pipelines save and load as ``PipelineModel``.
Their ``transform`` is built from the column expressions of
:mod:`gazrank.functions.text`: no Python UDF runs per row.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import ElementwiseProduct, IDF
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import preprocess as P


class ArticlePreprocessor(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """TXT7 as a stage: derives ``columns`` (titulo, tipo_edicao, joined
    texts, org levels) after filling nulls with ``fillna``."""

    columns = Param(Params._dummy(), "columns", "derived columns", TypeConverters.toListString)
    fillna = Param(Params._dummy(), "fillna", "null token", TypeConverters.toString)
    nLevels = Param(Params._dummy(), "nLevels", "org levels (0 = fit)", TypeConverters.toInt)

    @keyword_only
    def __init__(self, columns=None, fillna=None, nLevels=0):
        super().__init__()
        self._setDefault(columns=["tipo_edicao", "tit_org_ementa_text"], fillna=K.NULL_TOKEN_SPACED,
                         nLevels=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("columns")
        keep = [c for c in df.columns if c not in cols]
        n = self.getOrDefault("nLevels") or None
        return P.preprocess_articles(df, cols, fillna=self.getOrDefault("fillna"), keep=keep,
                                     n_levels=n)


class TextNormalizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                     DefaultParamsWritable):
    """TXT18 as a stage (post tokens, lowercase, money tokens, punctuation,
    stop words, accents, letters)."""

    lowercase = Param(Params._dummy(), "lowercase", "", TypeConverters.toBoolean)
    valueTokens = Param(Params._dummy(), "valueTokens", "", TypeConverters.toBoolean)
    punctuation = Param(Params._dummy(), "punctuation", "", TypeConverters.toBoolean)
    keepCash = Param(Params._dummy(), "keepCash", "", TypeConverters.toBoolean)
    stopwords = Param(Params._dummy(), "stopwords", "", TypeConverters.toListString)
    stripAccents = Param(Params._dummy(), "stripAccents", "", TypeConverters.toBoolean)
    onlyLetters = Param(Params._dummy(), "onlyLetters", "", TypeConverters.toBoolean)
    cargoTokens = Param(Params._dummy(), "cargoTokens", "", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, lowercase=True, valueTokens=True,
                 punctuation=True, keepCash=True, stopwords=None, stripAccents=True,
                 onlyLetters=True, cargoTokens=True):
        super().__init__()
        self._setDefault(lowercase=True, valueTokens=True, punctuation=True, keepCash=True,
                         stopwords=[], stripAccents=True, onlyLetters=True, cargoTokens=True)
        kw = dict(self._input_kwargs)
        if kw.get("stopwords") is None:
            kw.pop("stopwords", None)
        self._set(**kw)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        sw = g("stopwords") or None
        expr = T.normalize_text(g("inputCol"), lowercase=g("lowercase"), value_tokens=g("valueTokens"),
                                punctuation=g("punctuation"), keep_cash=g("keepCash"), stopwords=sw,
                                strip_accents=g("stripAccents"), only_letters=g("onlyLetters"),
                                cargo_tokens=g("cargoTokens"))
        return df.withColumn(g("outputCol"), expr)


class TextStemmer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """TXT10 / EXT3 as a stage: words stemmed at their place. ``stemmer`` names a class (``module:Name``) whose
    objects, made without arguments, have ``.stem(word)``; empty means no stemming."""

    stemmer = Param(Params._dummy(), "stemmer", "module:Name of the stemmer", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, stemmer=""):
        super().__init__()
        self._setDefault(stemmer="")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from importlib import import_module
        from ..operators.stemming import stem_words
        module, _, name = self.getOrDefault("stemmer").partition(":")
        made = getattr(import_module(module), name)() if module else None
        return stem_words(df, self.getOrDefault("inputCol"), self.getOrDefault("outputCol"), made)


def section_normalizer(section: int, inputCol: str, outputCol: str) -> TextNormalizer:
    opts = P.SECTION1_TEXT if section == 1 else P.SECTION2_TEXT
    return TextNormalizer(inputCol=inputCol, outputCol=outputCol, lowercase=opts["lowercase"],
                          valueTokens=opts["value_tokens"], punctuation=opts["punctuation"],
                          keepCash=opts["keep_cash"], stopwords=list(K.portuguese_stopwords()),
                          stripAccents=opts["strip_accents"], onlyLetters=opts["only_letters"],
                          cargoTokens=opts["cargo_tokens"])


class NgramTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                     DefaultParamsWritable):
    """TXT24 + TXT25: tokens of two or more word characters, n-grams
    ``nMin..nMax`` (one-character tokens are dropped before n-grams)."""

    nMin = Param(Params._dummy(), "nMin", "", TypeConverters.toInt)
    nMax = Param(Params._dummy(), "nMax", "", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, nMin=1, nMax=1):
        super().__init__()
        self._setDefault(nMin=1, nMax=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        return df.withColumn(g("outputCol"), T.ngrams(T.tokens(g("inputCol")), g("nMin"), g("nMax")))


class SmoothIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """VEC2 idf with the +1 of the reference: ``ln((1 + n)/(1 + df)) + 1``.

    Spark's ``IDF`` gives ``ln((n + 1)/(df + 1))``; the fitted stage is a
    built-in ``ElementwiseProduct`` by ``idf + 1`` (persistable as is)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        g = self.getOrDefault
        m = IDF(inputCol=g("inputCol"), outputCol="_idf_tmp", minDocFreq=0).fit(df)
        scale = DenseVector(m.idf.toArray() + 1.0)
        return ElementwiseProduct(scalingVec=scale, inputCol=g("inputCol"), outputCol=g("outputCol"))


def label_std(df: DataFrame, label: str, weight: str | None = None) -> tuple[float, float]:
    """Weighted sample std of the label (MLlib's unbiased form) and sum of
    weights, in one aggregate."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    r = df.agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * y).alias("swy"),
               F.sum(w * y * y).alias("swyy")).first()
    sw, sw2, swy, swyy = (float(r[k] or 0.0) for k in ("sw", "sw2", "swy", "swyy"))
    if sw <= 0:
        return 0.0, 0.0
    mean = swy / sw
    var = (swyy - sw * mean * mean) / max(sw - sw2 / sw, 1e-300)
    return max(var, 0.0) ** 0.5, sw


class _RidgeParams(Params):
    alpha = Param(Params._dummy(), "alpha", "", TypeConverters.toFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "", TypeConverters.toFloat)


class RidgeRegression(Estimator, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """MOD1: ``min sum w (y - X b - c)^2 + alpha |b|^2`` (intercept free; ``alpha`` above 0), solved over the rows
    (:mod:`row_ridge`) in fewer and smaller passes than the steps of MLlib's l-bfgs."""

    @keyword_only
    def __init__(self, alpha=1.0, featuresCol="features", labelCol="relevancia",
                 predictionCol="prediction", weightCol="", maxIter=1000, tol=1e-6):
        super().__init__()
        self._setDefault(alpha=1.0, featuresCol="features", labelCol="relevancia",
                         predictionCol="prediction", weightCol="", maxIter=1000, tol=1e-6)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        from .row_ridge import solve
        g = self.getOrDefault
        weight = F.col(g("weightCol")) if g("weightCol") else F.lit(1.0)
        rows = df.select(F.col(g("labelCol")).cast("double").alias("y"), weight.cast("double").alias("w"), F.col(g("featuresCol")).alias("f"))
        model = self._copyValues(RidgeModel(*solve(rows, g("alpha"), g("tol"), g("maxIter"))))
        return model._resetUid(self.uid)


class RidgeModel(Model, _RidgeParams, MLReadable, MLWritable):
    """Fitted :class:`RidgeRegression`: ``coefficients`` and ``intercept``."""

    def __init__(self, coefficients: DenseVector | None = None, intercept: float = 0.0):
        super().__init__()
        self.coefficients, self.intercept = coefficients, intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        from .row_ridge import predicted
        g = self.getOrDefault
        return df.withColumn(g("predictionCol"), predicted(df.sparkSession, F.col(g("featuresCol")), self.coefficients.toArray(), self.intercept))

    def write(self) -> MLWriter:
        return _RidgeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RidgeReader()


class _RidgeWriter(MLWriter):
    def __init__(self, instance: RidgeModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"intercept": m.intercept})
        self.sparkSession.createDataFrame([(m.coefficients,)], ["coefficients"]).coalesce(1).write.parquet(f"{path}/data")


class _RidgeReader(MLReader):
    def load(self, path: str) -> RidgeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RidgeModel(self.sparkSession.read.parquet(f"{path}/data").first()[0], metadata["intercept"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _TextRidgeParams(Params):
    alpha = Param(Params._dummy(), "alpha", "", TypeConverters.toFloat)
    termsCol = Param(Params._dummy(), "termsCol", "lists of terms", TypeConverters.toString)
    extraCol = Param(Params._dummy(), "extraCol", "one more feature", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "column that fixes the terms (empty: the terms)", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "", TypeConverters.toString)
    binary = Param(Params._dummy(), "binary", "", TypeConverters.toBoolean)
    useIdf = Param(Params._dummy(), "useIdf", "", TypeConverters.toBoolean)
    norm = Param(Params._dummy(), "norm", "l1, l2 or empty", TypeConverters.toString)
    tol = Param(Params._dummy(), "tol", "", TypeConverters.toFloat)

    def weighting(self):
        from .ridge_path import Weighting
        g = self.getOrDefault
        return Weighting(binary=g("binary"), use_idf=g("useIdf"), norm=g("norm") or None)


class TextRidge(Estimator, _TextRidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """VEC1/VEC2 + VEC8 + MOD1 in one fit: a ridge on the (binary) counts of ``termsCol``'s terms, times the smooth idf,
    divided by the row's norm, and on ``extraCol``. Every term is a feature; they are a table, never the driver's (:mod:`dual_ridge`)."""

    #: :func:`models.fit_cached` need not hold the input.
    reads_once = True

    @keyword_only
    def __init__(self, alpha=1.0, termsCol="terms", extraCol="tipo_vec", keyCol="", labelCol="relevancia", predictionCol="prediction",
                 binary=True, useIdf=True, norm="", tol=1e-7):
        super().__init__()
        self._setDefault(alpha=1.0, termsCol="terms", extraCol="tipo_vec", keyCol="", labelCol="relevancia", predictionCol="prediction",
                         binary=True, useIdf=True, norm="", tol=1e-7)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        from . import dual_ridge as DR
        g = self.getOrDefault
        data = DR.counted(df, [g("termsCol")], g("labelCol"), g("extraCol"))
        try:
            solved = DR.solve(data, [DR.Job(self.weighting(), (data.y == data.y).astype("int8"), data.y)], [g("alpha")], tol=g("tol"))
            return self._copyValues(TextRidgeModel(*DR.coefficients(solved)))
        finally:
            data.close()


class TextRidgeModel(Model, _TextRidgeParams, MLReadable, MLWritable):
    """Fitted :class:`TextRidge`: a table ``(term, idf, weight)``, the weight of the extra feature, the intercept.

    Rows are scored by a join of their terms with the table, once for each different ``keyCol``; a stream is scored by its batches.
    """

    def __init__(self, weights: DataFrame | None = None, extra: float = 0.0, intercept: float = 0.0):
        super().__init__()
        self.weights, self.extra, self.intercept = weights, extra, intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        source = F.col(g("keyCol") or g("termsCol"))
        keyed = df.withColumn("_k", F.struct(F.xxhash64(source), F.xxhash64(F.lit("key"), source)))
        terms = F.array_distinct(g("termsCol")) if g("binary") else F.col(g("termsCol"))
        cells = keyed.select("_k", F.explode(terms).alias("term"))
        if g("binary"):
            cells = cells.withColumn("_n", F.lit(1))
        else:
            cells = cells.groupBy("_k", "term").agg(F.count(F.lit(1)).alias("_n"))
        # a key that several rows share has each cell once for each of them
        value = F.col("_n") * F.col("idf")
        sums = (cells.join(self.weights, "term").groupBy("_k")
                .agg(F.sum(value * F.col("weight")).alias("_s"), F.sum(value if g("norm") == "l1" else value * value).alias("_q")))
        sums = sums.join(keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")), "_k")
        if g("norm") == "l1":
            size = F.col("_q") / F.col("_c")
        elif g("norm") == "l2":
            size = F.sqrt(F.col("_q") / (F.col("_c") if g("binary") else F.col("_c") * F.col("_c")))
        else:
            size = F.lit(1.0)
        sums = sums.select("_k", F.coalesce(F.try_divide(F.col("_s") / F.col("_c"), size), F.lit(0.0)).alias("_s"))
        score = F.coalesce("_s", F.lit(0.0)) + F.col(g("extraCol")) * self.extra + self.intercept
        return keyed.join(sums, "_k", "left").withColumn(g("predictionCol"), score).drop("_k", "_s")

    def write(self) -> MLWriter:
        return _TextRidgeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TextRidgeReader()


class _TextRidgeWriter(MLWriter):
    def __init__(self, instance: TextRidgeModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"extra": m.extra, "intercept": m.intercept})
        m.weights.write.parquet(f"{path}/weights")


class _TextRidgeReader(MLReader):
    def load(self, path: str) -> TextRidgeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextRidgeModel(self.sparkSession.read.parquet(f"{path}/weights"), metadata["extra"], metadata["intercept"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
