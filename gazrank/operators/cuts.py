"""Selection cuts, projections and simple filters (FLT*, PRJ*).

Every cut is one boolean ``Column``; Spark evaluates it in whole-stage
codegen right after the Parquet scan, with SQL three-valued logic (a null
input makes the predicate null, which drops the row, as the warehouse SQL
did).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _organ_cut(organs: list[str]) -> list[Column]:
    orgao = F.col("orgao")
    low = F.lower(orgao)
    first_level = F.split(orgao, "/").getItem(0)
    conds = [~low.like(f"%{w}%") for w in K.EXCLUDED_ORGAN_WORDS]
    conds.append(~first_level.isin(organs))
    conds.append(~orgao.isin(organs))
    return conds


def _extra_edition() -> Column:
    return F.lower(F.col("edicao")).contains("-")


def section1_cut() -> Column:
    """FLT1: section-1 selection."""
    title = F.lower(F.col("identifica"))
    conds = [F.col("secao") == 1,
             _any([title.like(f"%{w}%") for w in K.SECTION1_TITLE_WORDS]),
             ~_extra_edition()]
    conds += _organ_cut(K.EXCLUDED_ORGANS)
    conds += [~F.col("orgao").like(f"%{p}%") for p in K.SECTION1_EXCLUDED_ORGAN_PARTS]
    return _all(conds)


def _section2_organ_and_text() -> list[Column]:
    low_org = F.lower(F.col("orgao"))
    low_txt = F.lower(F.col("fulltext"))
    conds = _organ_cut(K.EXCLUDED_ORGANS + [K.POWER_LEGISLATIVE])
    conds += [~low_org.like(f"%{w}%") for w in K.SECTION2_EXCLUDED_ORGAN_WORDS]
    conds += [~low_txt.like(f"%{w}%") for w in K.SECTION2_EXCLUDED_TEXT_WORDS]
    return conds


def section2_cut() -> Column:
    """FLT2: section-2 selection."""
    return _all([F.col("secao") == 2, ~_extra_edition()] + _section2_organ_and_text())


def section3_cut() -> Column:
    """FLT3: section-3 selection."""
    return _all([F.col("secao") == 3, ~_extra_edition()] + _organ_cut(K.EXCLUDED_ORGANS))


def extra_edition_cut() -> Column:
    """FLT4: extra editions of any section."""
    return _all([_extra_edition()] + _organ_cut(K.EXCLUDED_ORGANS))


def any_cut() -> Column:
    """FLT5: OR of the four cuts."""
    return section1_cut() | section2_cut() | section3_cut() | extra_edition_cut()


def pool_cut(max_date: str = K.POOL_MAX_DATE) -> Column:
    """Section-2 cut of the sampling pool: no edition test, date bound."""
    return _all([F.col("data_pub") < max_date, F.col("secao") == 2]
                + _section2_organ_and_text())


def drop_null_url(df: DataFrame) -> DataFrame:
    """FLT6: url is the identifier."""
    return df.filter(F.col("url").isNotNull())


def null_url_report(df: DataFrame) -> DataFrame:
    """FLT6 report: number and share of rows without url."""
    return df.agg(
        F.count_if(F.col("url").isNull()).cast("bigint").alias("n_null_url"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.round(F.avg(F.col("url").isNull().cast("double")), 6).alias("frac_null_url"),
    )


def drop_null_text(df: DataFrame) -> DataFrame:
    """FLT7."""
    return df.na.drop(subset=["fulltext"])


def select_section(df: DataFrame, secao: int) -> DataFrame:
    """FLT8."""
    return df.filter(F.col("secao") == secao)


def catastrophic_errors(df: DataFrame, label: str = "relevancia", score: str = "score",
                        low: float = 2.5, high: float = 3.5) -> DataFrame:
    """FLT9: relevant rows scored low and irrelevant rows scored high."""
    lab = F.col(label)
    kind = (F.when(lab.isin(4, 5) & (F.col(score) < low), F.lit("missed"))
            .when(lab.isin(1, 2) & (F.col(score) > high), F.lit("false_alarm")))
    return df.withColumn("error_kind", kind).filter(F.col("error_kind").isNotNull())


def das4_relabel_candidates(df: DataFrame, before: str = K.DAS4_MAX_DATE,
                            min_label: int = 3) -> DataFrame:
    """FLT10: old articles naming a DAS-4 post (case-sensitive) with label >= 3."""
    return (df.filter(F.col("data_pub") < before)
            .filter(F.col("fulltext").rlike(K.DAS4_PATTERN))
            .filter(F.col("relevancia") >= min_label))


def post_with_label(df: DataFrame, pattern: str = K.DAS4_PATTERN, label: int = 5) -> DataFrame:
    """FLT10, first look: articles of one label (the top one) that name a post (DAS-4)."""
    return df.filter((F.col("relevancia") == label) & F.col("fulltext").rlike(pattern))


def text_limit(col: str = "fulltext", limit: int = K.TEXT_LIMIT) -> Column:
    """PRJ2: long texts are cut to ``limit`` characters plus '...'."""
    c = F.col(col)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def sampling_pool(all_articles: DataFrame, classified_df: DataFrame) -> DataFrame:
    """PRJ2 + JN3: unlabelled section-2 articles not already classified.

    ``url NOT IN (subquery)`` is null-aware: a null outer url is dropped
    (unless the subquery is empty), so null urls are removed first and a
    plain anti join does the rest.
    """
    known = classified_df.select("url").filter(F.col("url").isNotNull()).distinct()
    base = all_articles.filter(pool_cut())
    has_known = known.limit(1).count() > 0
    if has_known:
        base = base.filter(F.col("url").isNotNull())
    out = base.join(known, "url", "left_anti")
    return out.select(
        F.col("doc_id"), F.lit(None).cast("int").alias("relevancia"), "identifica", "orgao",
        "ementa", "resumo", text_limit().alias("fulltext"), "secao", "edicao", "pagina",
        "data_pub", "assina", "cargo", "url", "url_certificado")


# ---------------------------------------------------------------------------
# SQL text of the same cuts (DuckDB oracle, or Spark SQL users)
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_organ_cut(organs: list[str]) -> list[str]:
    lst = ", ".join(_q(o) for o in organs)
    conds = [f"lower(orgao) NOT LIKE {_q('%' + w + '%')}" for w in K.EXCLUDED_ORGAN_WORDS]
    conds.append(f"string_split(orgao, '/')[1] NOT IN ({lst})")
    conds.append(f"orgao NOT IN ({lst})")
    return conds


def sql_section1_cut() -> str:
    title = " OR ".join(f"lower(identifica) LIKE {_q('%' + w + '%')}" for w in K.SECTION1_TITLE_WORDS)
    conds = ["secao = 1", f"({title})", "NOT contains(lower(edicao), '-')"]
    conds += _sql_organ_cut(K.EXCLUDED_ORGANS)
    conds += [f"orgao NOT LIKE {_q('%' + p + '%')}" for p in K.SECTION1_EXCLUDED_ORGAN_PARTS]
    return "(" + " AND ".join(conds) + ")"


def _sql_section2_rest() -> list[str]:
    conds = _sql_organ_cut(K.EXCLUDED_ORGANS + [K.POWER_LEGISLATIVE])
    conds += [f"lower(orgao) NOT LIKE {_q('%' + w + '%')}" for w in K.SECTION2_EXCLUDED_ORGAN_WORDS]
    conds += [f"lower(fulltext) NOT LIKE {_q('%' + w + '%')}" for w in K.SECTION2_EXCLUDED_TEXT_WORDS]
    return conds


def sql_section2_cut() -> str:
    return "(" + " AND ".join(["secao = 2", "NOT contains(lower(edicao), '-')"]
                              + _sql_section2_rest()) + ")"


def sql_section3_cut() -> str:
    return "(" + " AND ".join(["secao = 3", "NOT contains(lower(edicao), '-')"]
                              + _sql_organ_cut(K.EXCLUDED_ORGANS)) + ")"


def sql_extra_edition_cut() -> str:
    return "(" + " AND ".join(["contains(lower(edicao), '-')"] + _sql_organ_cut(K.EXCLUDED_ORGANS)) + ")"


def sql_any_cut() -> str:
    return "(" + " OR ".join([sql_section1_cut(), sql_section2_cut(), sql_section3_cut(),
                              sql_extra_edition_cut()]) + ")"


def sql_pool_cut(max_date: str = K.POOL_MAX_DATE) -> str:
    return "(" + " AND ".join([f"data_pub < {_q(max_date)}", "secao = 2"] + _sql_section2_rest()) + ")"
