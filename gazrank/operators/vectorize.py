"""Bag-of-words features in long form ``(id, term, value)`` (VEC*, AGG13-14).

The long form is the distributed term-document matrix: it never lives on
the driver, the vocabulary is a table (``term, df, idx``) of any size, and
joins on ``term`` give weights, keyword boosts and similarity.  Binary
features use ``array_distinct`` before ``explode``, so building them is a
narrow (shuffle-free) transformation; document frequencies are a partial
aggregate by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import with_position


def doc_terms(df: DataFrame, id_col: str, text_col: str, n_min: int = 1, n_max: int = 1,
              binary: bool = True) -> DataFrame:
    """``(id, term, tf)``: n-grams of the TXT24 tokens of ``text_col``."""
    grams = T.ngrams(T.tokens(text_col), n_min, n_max)
    if binary:
        return (df.select(F.col(id_col), F.explode(F.array_distinct(grams)).alias("term"))
                .withColumn("tf", F.lit(1).cast("long")))
    ex = df.select(F.col(id_col), F.explode(grams).alias("term"))
    return ex.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def df_bounds(n_docs: int, min_df: float = 1, max_df: float = 1.0) -> tuple[float, float]:
    """sklearn semantics: an int is a count, a float a share of documents."""
    low = min_df if isinstance(min_df, int) else min_df * n_docs
    high = max_df if isinstance(max_df, int) else max_df * n_docs
    return float(low), float(high)


def fit_vocabulary(terms: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 1.0,
                   with_index: bool = True) -> DataFrame:
    """Vocabulary ``(term, df[, idx])``: ``min_df <= df <= max_df``.

    ``terms`` holds one row per (document, term).  ``idx`` is the
    alphabetical index (0-based), built without a single-task sort.
    """
    low, high = df_bounds(n_docs, min_df, max_df)
    voc = (terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
           .filter((F.col("df") >= low) & (F.col("df") <= high)))
    if with_index:
        voc = with_position(voc, ["term"], name="idx").withColumn("idx", F.col("idx") - 1)
    return voc


def restrict(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep in-vocabulary terms (out-of-vocabulary terms are ignored)."""
    return terms.join(vocab.select("term"), "term", "left_semi")


def sklearn_idf(vocab: DataFrame, n_docs: int) -> DataFrame:
    """VEC2 idf: ``ln((1 + n) / (1 + df)) + 1`` (smooth idf)."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf(terms: DataFrame, vocab_idf: DataFrame, id_col: str, use_idf: bool = True,
          norm: str | None = None) -> DataFrame:
    """VEC2/VEC3: ``(id, term, value)`` = tf (x idf), optional l1/l2 row norm."""
    j = terms.join(vocab_idf.select("term", "idf"), "term")
    val = F.col("tf").cast("double") * (F.col("idf") if use_idf else F.lit(1.0))
    out = j.select(id_col, "term", val.alias("value"))
    if norm in ("l1", "l2"):
        agg = F.sum(F.abs("value")) if norm == "l1" else F.sqrt(F.sum(F.col("value") ** 2))
        nrm = out.groupBy(id_col).agg(agg.alias("_norm"))
        out = (out.join(nrm, id_col)
               .withColumn("value", F.col("value") / F.col("_norm")).drop("_norm"))
    return out


def keyword_terms(spark: SparkSession, keywords: list[str], anti_keywords: list[str] | None,
                  vocab: DataFrame, preprocess, n_max: int = 1, min_df: float = 1,
                  max_df: float = 1.0) -> DataFrame:
    """VEC4: tokens of ``keywords`` minus tokens of ``anti_keywords``, inside
    the model vocabulary.  The keyword strings go through ``preprocess``
    (a ``Column -> Column`` normaliser) and the vectorizer's own df bounds.
    """
    def vocab_of(words):
        kdf = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "kid int, text string")
        kdf = kdf.withColumn("text", preprocess(F.col("text")))
        t = doc_terms(kdf, "kid", "text", 1, n_max, binary=True)
        return fit_vocabulary(t, len(words), min_df, max_df, with_index=False).select("term")

    keys = vocab_of(keywords)
    if anti_keywords:
        keys = keys.join(vocab_of(anti_keywords), "term", "left_anti")
    return keys.join(vocab.select("term"), "term", "left_semi")


def weighted_counts(terms: DataFrame, key_terms: DataFrame, weight: float) -> DataFrame:
    """VEC4 transform: keyword terms get ``tf * weight``.

    ``key_terms`` comes from a user keyword list: its size is bounded by that
    list, so it is broadcast.
    """
    hit = F.broadcast(key_terms.select("term").withColumn("_hit", F.lit(True)))
    j = terms.join(hit, "term", "left")
    return j.withColumn("value", F.when(F.col("_hit"), F.col("tf") * F.lit(float(weight)))
                        .otherwise(F.col("tf").cast("double"))).drop("_hit")


def multicolumn_counts(df: DataFrame, id_col: str, text_cols: list[str], weights: list[float],
                       agg: str = "max", binary: bool = True, n_max: int = 1,
                       min_df: float = 1, max_df: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """VEC5: one vocabulary over the space-joined columns (null -> ''); each
    column counted separately, times its weight, combined by max or sum.

    Returns ``(vocab, values)``.  For ``max`` a column that lacks a term
    counts as 0 (sparse semantics), which matters for negative weights.
    """
    if len(text_cols) != len(weights):
        raise ValueError("one weight per column")
    if agg not in ("max", "sum"):
        raise ValueError("agg must be 'max' or 'sum'")
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    n = df.count()
    all_terms = doc_terms(df.select(id_col, joined.alias("_all")), id_col, "_all", 1, n_max, True)
    vocab = fit_vocabulary(all_terms, n, min_df, max_df)
    stacked = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.col(c).alias("text"), F.lit(float(w)).alias("w"))
        for i, (c, w) in enumerate(zip(text_cols, weights))])).alias("s"))
    stacked = stacked.select(id_col, "s.col_idx", "s.text", "s.w")
    grams = T.ngrams(T.tokens("text"), 1, n_max)
    if binary:
        per = stacked.select(id_col, "col_idx", "w", F.explode(F.array_distinct(grams)).alias("term"))
        per = per.withColumn("tf", F.lit(1.0))
    else:
        per = (stacked.select(id_col, "col_idx", "w", F.explode(grams).alias("term"))
               .groupBy(id_col, "col_idx", "w", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    low, high = df_bounds(n, min_df, max_df)
    # Bounds that every term meets leave the vocabulary whole: a column's n-grams are among those of the joined text.
    if low > 1 or high < n:
        per = restrict(per, vocab)
    per = per.withColumn("v", F.col("tf") * F.col("w"))
    g = per.groupBy(id_col, "term")
    if agg == "sum":
        vals = g.agg(F.sum("v").alias("value"))
    else:
        vals = g.agg(F.max("v").alias("_mx"), F.count(F.lit(1)).alias("_k")).select(
            id_col, "term",
            F.when(F.col("_k") < len(text_cols), F.greatest(F.col("_mx"), F.lit(0.0)))
            .otherwise(F.col("_mx")).alias("value"))
    return vocab, vals.filter(F.col("value") != 0)


def sparse_max(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """VEC6: element-wise max of two long-form matrices (absent = 0)."""
    j = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), keys, "full")
    v = F.greatest(F.coalesce(F.col("_a"), F.lit(0.0)), F.coalesce(F.col("_b"), F.lit(0.0)))
    return j.select(*keys, v.alias("value")).filter(F.col("value") != 0)


def term_in_every_doc(terms: DataFrame, n_docs: int) -> DataFrame:
    """AGG13: does any term occur in every document?"""
    dfs = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return dfs.agg(F.lit(n_docs).cast("bigint").alias("n_docs"),
                   F.max("df").cast("bigint").alias("max_df"),
                   (F.max("df") >= n_docs).alias("any_in_all"))


def stem_terms(terms: DataFrame, stemmer) -> DataFrame:
    """TXT10 / EXT3: pluggable stemmer (any object with ``.stem(word)``).

    The stemmer runs once per *distinct* term, in an Arrow-batched pandas
    UDF, and the result is joined back; texts are never stemmed row by row.
    ``stemmer=None`` (every configured pipeline) is the identity.
    """
    if stemmer is None:
        return terms
    import pandas as pd

    def _stem_batch(s):
        return s.map(stemmer.stem)

    # real annotation objects (this module uses postponed annotations)
    _stem_batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    _stem = F.pandas_udf(_stem_batch, "string")

    distinct = terms.select("term").distinct()
    mapping = distinct.withColumn("stem", _stem(F.col("term")))
    return (terms.join(mapping, "term").drop("term").withColumnRenamed("stem", "term"))
