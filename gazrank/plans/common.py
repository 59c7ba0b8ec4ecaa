"""Inputs shared by the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts
from ..operators.splits import nested_split_label, sql_nested_split_label
from ..sources import tables


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return tables.articles(spark, sf)


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled articles with url and text that pass the selection cuts."""
    a = articles(spark, sf)
    return (a.filter(F.col("relevancia").isNotNull())
            .filter(cuts.any_cut())
            .filter(F.col("url").isNotNull())
            .filter(F.col("fulltext").isNotNull()))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """``base`` with the nested hash split label."""
    return base(spark, sf).withColumn("split", nested_split_label("url"))


def score() -> Column:
    """Deterministic stand-in score for ranking / metric checks."""
    return (F.col("relevancia") + ((F.col("doc_id") * 37) % 101) / 20.0 - 2.5).cast("double")


SQL_SCORE = "CAST(relevancia + ((doc_id * 37) % 101) / 20.0 - 2.5 AS DOUBLE)"


def sql(body: str, extra: str = "") -> str:
    """Prelude of standard CTEs + ``extra`` CTEs (each ``name AS (...)``) + body."""
    ctes = [
        f"articles AS ({tables.ARTICLES_SQL})",
        "classified AS (SELECT * FROM articles WHERE relevancia IS NOT NULL)",
        "curated AS (SELECT * EXCLUDE (relevancia, data_registro), CAST(5 AS INT) AS relevancia "
        "FROM articles WHERE doc_id % 5 = 4)",
        "pool AS (SELECT * FROM articles WHERE relevancia IS NULL)",
        f"base AS (SELECT * FROM classified WHERE {cuts.sql_any_cut()} AND url IS NOT NULL "
        "AND fulltext IS NOT NULL)",
        f"splits AS (SELECT *, {sql_nested_split_label('url')} AS split FROM base)",
        f"scored AS (SELECT *, {SQL_SCORE} AS score FROM splits)",
    ]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
