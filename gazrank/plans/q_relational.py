"""Registered queries: cuts, projections, joins, set operations, aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import cuts
from ..sources import tables
from .common import articles, base, score, splits, sql
from .registry import register

ALL_CUT_COLS = "doc_id, secao, edicao, orgao, identifica"


def _cut_cols(df):
    return df.select("doc_id", "secao", "edicao", "orgao", "identifica")


# --------------------------------------------------------------------- FLT


@register("flt1_section1_cut",
          lambda: sql(f"SELECT {ALL_CUT_COLS} FROM articles WHERE {cuts.sql_section1_cut()}"))
def flt1(spark, sf):
    return _cut_cols(articles(spark, sf).filter(cuts.section1_cut()))


@register("flt2_section2_cut",
          lambda: sql(f"SELECT {ALL_CUT_COLS} FROM articles WHERE {cuts.sql_section2_cut()}"))
def flt2(spark, sf):
    return _cut_cols(articles(spark, sf).filter(cuts.section2_cut()))


@register("flt3_section3_cut",
          lambda: sql(f"SELECT {ALL_CUT_COLS} FROM articles WHERE {cuts.sql_section3_cut()}"))
def flt3(spark, sf):
    return _cut_cols(articles(spark, sf).filter(cuts.section3_cut()))


@register("flt4_extra_edition_cut",
          lambda: sql(f"SELECT {ALL_CUT_COLS} FROM articles WHERE {cuts.sql_extra_edition_cut()}"))
def flt4(spark, sf):
    return _cut_cols(articles(spark, sf).filter(cuts.extra_edition_cut()))


@register("flt5_any_cut_classified",
          lambda: sql("SELECT doc_id, relevancia, secao FROM classified WHERE "
                      f"identifica IS NOT NULL AND {cuts.sql_any_cut()}"))
def flt5(spark, sf):
    a = tables.classified(articles(spark, sf))
    return (a.filter(F.col("identifica").isNotNull() & cuts.any_cut())
            .select("doc_id", "relevancia", "secao"))


@register("flt6_null_url_report",
          lambda: sql("SELECT CAST(count_if(url IS NULL) AS BIGINT) AS n_null_url, "
                      "CAST(count(*) AS BIGINT) AS n_rows, "
                      "round(avg(CASE WHEN url IS NULL THEN 1.0 ELSE 0.0 END), 6) AS frac_null_url "
                      "FROM classified"))
def flt6(spark, sf):
    return cuts.null_url_report(tables.classified(articles(spark, sf)))


def _union_sources(spark, sf):
    """SET1 input: labelled rows with url + curated rows not already labelled."""
    a = articles(spark, sf)
    cls = cuts.drop_null_url(tables.classified(a)).withColumn("fulltext",
                                                              T.clean_certified("fulltext"))
    cur = tables.curated(a)
    cur_new = cur.join(cls.select("url").distinct(), "url", "left_anti")
    cur_new = cur_new.withColumn("fulltext", T.clean_certified("fulltext"))
    return (cls.withColumn("src", F.lit("classified"))
            .unionByName(cur_new.withColumn("src", F.lit("curated")), allowMissingColumns=True))


_SQL_UNION = ("u AS (SELECT doc_id, relevancia, data_registro, fulltext, 'classified' AS src "
              "FROM classified WHERE url IS NOT NULL UNION ALL "
              "SELECT doc_id, relevancia, NULL AS data_registro, fulltext, 'curated' AS src "
              "FROM curated c WHERE NOT EXISTS (SELECT 1 FROM classified k "
              "WHERE k.url IS NOT NULL AND k.url = c.url))")


@register("flt7_drop_null_text",
          lambda: sql("SELECT doc_id, src FROM u WHERE fulltext IS NOT NULL", _SQL_UNION))
def flt7(spark, sf):
    return cuts.drop_null_text(_union_sources(spark, sf)).select("doc_id", "src")


@register("flt8_select_section",
          lambda: sql("SELECT doc_id, split FROM splits WHERE secao = 1"))
def flt8(spark, sf):
    return cuts.select_section(splits(spark, sf), 1).select("doc_id", "split")


@register("flt9_catastrophic_errors",
          lambda: sql("SELECT doc_id, relevancia, round(score, 6) AS score, CASE "
                      "WHEN relevancia IN (4, 5) AND score < 2.5 THEN 'missed' "
                      "WHEN relevancia IN (1, 2) AND score > 3.5 THEN 'false_alarm' END AS error_kind "
                      "FROM scored WHERE (relevancia IN (4, 5) AND score < 2.5) "
                      "OR (relevancia IN (1, 2) AND score > 3.5)"))
def flt9(spark, sf):
    s = splits(spark, sf).withColumn("score", score())
    return (cuts.catastrophic_errors(s)
            .select("doc_id", "relevancia", F.round("score", 6).alias("score"), "error_kind"))


@register("flt10_das4_relabel",
          lambda: sql("SELECT doc_id, relevancia, data_pub FROM base WHERE data_pub < '2020-06-15' "
                      "AND regexp_matches(fulltext, 'DAS[ -]*?[0123]{3}\\.4') AND relevancia >= 3"))
def flt10(spark, sf):
    return cuts.das4_relabel_candidates(base(spark, sf)).select("doc_id", "relevancia", "data_pub")


@register("flt10_das4_top_label",
          lambda: sql(" UNION ALL ".join(
              f"SELECT doc_id, secao, data_pub, {n} AS post FROM classified WHERE relevancia = 5 "
              f"AND regexp_matches(fulltext, '{p}')" for n, p in ((4, K.DAS4_PATTERN), (6, K.DAS6_PATTERN)))))
def flt10_top(spark, sf):
    """Top-label articles that name a DAS-4 post, and a DAS-6 post (which the test tables have)."""
    a = tables.classified(articles(spark, sf))
    by = [cuts.post_with_label(a, p).select("doc_id", "secao", "data_pub", F.lit(n).alias("post"))
          for n, p in ((4, K.DAS4_PATTERN), (6, K.DAS6_PATTERN))]
    return by[0].unionByName(by[1])


@register("flt10_nomear_filter",
          lambda: sql("SELECT doc_id FROM base WHERE contains(lower(fulltext), 'nomear')"))
def flt10b(spark, sf):
    return base(spark, sf).filter(F.lower("fulltext").contains("nomear")).select("doc_id")


# --------------------------------------------------------------------- PRJ

_PRJ1_COLS = ["doc_id", "relevancia", "identifica", "secao", "edicao", "pagina", "data_pub",
              "orgao", "ementa", "resumo", "fulltext", "assina", "cargo", "url", "url_certificado"]


@register("prj1_second_source_projection",
          lambda: sql(f"SELECT {', '.join(_PRJ1_COLS)} FROM curated "
                      f"WHERE identifica IS NOT NULL AND {cuts.sql_any_cut()}"))
def prj1(spark, sf):
    cur = tables.curated(articles(spark, sf))
    return cur.filter(F.col("identifica").isNotNull() & cuts.any_cut()).select(*_PRJ1_COLS)


@register("prj2_sampling_pool",
          lambda: sql("SELECT doc_id, relevancia, CAST(length(fulltext) AS BIGINT) AS text_len, "
                      "md5(fulltext) AS text_md5, url FROM ("
                      "SELECT doc_id, CAST(NULL AS INT) AS relevancia, CASE WHEN length(fulltext) > 49990 "
                      "THEN substr(fulltext, 1, 49990) || '...' ELSE fulltext END AS fulltext, url "
                      "FROM articles WHERE url NOT IN (SELECT url FROM classified WHERE url IS NOT NULL) "
                      f"AND {cuts.sql_pool_cut()})"))
def prj2(spark, sf):
    a = articles(spark, sf)
    p = cuts.sampling_pool(a, tables.classified(a))
    return p.select("doc_id", "relevancia", F.length("fulltext").cast("bigint").alias("text_len"),
                    F.md5("fulltext").alias("text_md5"), "url")


@register("prj3_target_split",
          lambda: sql("SELECT doc_id, relevancia FROM base"))
def prj3(spark, sf):
    return base(spark, sf).select("doc_id", "relevancia")


# --------------------------------------------------------------------- JN / SET


@register("jn1_curated_anti_join",
          lambda: sql("SELECT doc_id, url FROM curated c WHERE NOT EXISTS (SELECT 1 FROM classified k "
                      "WHERE k.url IS NOT NULL AND k.url = c.url)"))
def jn1(spark, sf):
    a = articles(spark, sf)
    known = cuts.drop_null_url(tables.classified(a)).select("url").distinct()
    return tables.curated(a).join(known, "url", "left_anti").select("doc_id", "url")


@register("jn2_semi_join_class_counts",
          lambda: sql("SELECT relevancia, CAST(count(*) AS BIGINT) AS n FROM classified k "
                      "WHERE url IS NOT NULL AND url IN (SELECT url FROM curated) "
                      "GROUP BY relevancia"))
def jn2(spark, sf):
    a = articles(spark, sf)
    cls = cuts.drop_null_url(tables.classified(a))
    cur = tables.curated(a).select("url").filter(F.col("url").isNotNull())
    return (cls.join(cur, "url", "left_semi").groupBy("relevancia")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.desc("relevancia")))


@register("jn3_null_aware_not_in",
          lambda: sql("SELECT doc_id FROM articles WHERE url NOT IN "
                      "(SELECT url FROM classified WHERE url IS NOT NULL)"))
def jn3(spark, sf):
    a = articles(spark, sf)
    known = tables.classified(a).select("url").filter(F.col("url").isNotNull()).distinct()
    if known.isEmpty():  # nothing to be in: every row stays, null urls too
        return a.select("doc_id")
    # null-aware NOT IN: against a non-empty list null urls drop
    return a.filter(F.col("url").isNotNull()).join(known, "url", "left_anti").select("doc_id")


_SQL_WEIGHTS = ("freq AS (SELECT relevancia, count(*)::DOUBLE / sum(count(*)) OVER () AS f "
                "FROM classified WHERE url IS NOT NULL GROUP BY relevancia), "
                "val AS (SELECT * FROM splits WHERE split = 'val'), "
                "vc AS (SELECT relevancia, count(*) AS c FROM val GROUP BY relevancia), "
                "nv AS (SELECT count(*) AS n FROM val)")


def class_weights(spark, sf):
    """SPL9 weights: ``round_half_even(class_freq * n) / class_count``."""
    a = articles(spark, sf)
    freq = A.class_frequency(cuts.drop_null_url(tables.classified(a)))
    val = splits(spark, sf).filter(F.col("split") == "val")
    n_val = val.count()
    vc = val.groupBy("relevancia").agg(F.count(F.lit(1)).alias("c"))
    # exact fraction (not the rounded report column)
    tot = F.sum("n").over(Window.partitionBy(F.lit(0)))
    freq = freq.withColumn("f", F.col("n") / tot)
    w = freq.join(vc, "relevancia").select(
        "relevancia", (F.bround(F.col("f") * n_val, 0) / F.col("c")).alias("weight"))
    return val, w


@register("jn4_class_weight_join",
          lambda: sql("SELECT v.doc_id, v.relevancia, round(round_even(f.f * nv.n, 0) / vc.c, 6) AS weight "
                      "FROM val v LEFT JOIN freq f USING (relevancia) LEFT JOIN vc USING (relevancia) "
                      "CROSS JOIN nv", _SQL_WEIGHTS))
def jn4(spark, sf):
    val, w = class_weights(spark, sf)
    # one row per class: a size bound by construction
    return (val.join(F.broadcast(w), "relevancia", "left")
            .select("doc_id", "relevancia", F.round("weight", 6).alias("weight")))


@register("set1_union_sources",
          lambda: sql("SELECT doc_id, relevancia, data_registro, src FROM u", _SQL_UNION))
def set1(spark, sf):
    return _union_sources(spark, sf).select("doc_id", "relevancia", "data_registro", "src")


@register("set2_train_val_union",
          lambda: sql("SELECT doc_id, split FROM splits WHERE split = 'train' UNION ALL "
                      "SELECT doc_id, split FROM splits WHERE split = 'val'"))
def set2(spark, sf):
    s = splits(spark, sf)
    return (s.filter(F.col("split") == "train").select("doc_id", "split")
            .unionByName(s.filter(F.col("split") == "val").select("doc_id", "split")))


# --------------------------------------------------------------------- AGG


@register("agg1_class_frequency",
          lambda: sql("SELECT relevancia, CAST(count(*) AS BIGINT) AS n, "
                      "round(count(*) / sum(count(*)) OVER (), 6) AS freq FROM classified "
                      "WHERE url IS NOT NULL GROUP BY relevancia"))
def agg1(spark, sf):
    return A.class_frequency(cuts.drop_null_url(tables.classified(articles(spark, sf))))


@register("agg2_class_split_table",
          lambda: sql("SELECT relevancia, CAST(count_if(split = 'train') AS BIGINT) AS n_train, "
                      "CAST(count_if(split = 'val') AS BIGINT) AS n_val, "
                      "CAST(count_if(split = 'test') AS BIGINT) AS n_test, "
                      "count_if(split = 'train') > 0 AND count_if(split = 'val') > 0 "
                      "AND count_if(split = 'test') > 0 AS all_present FROM splits GROUP BY relevancia"))
def agg2(spark, sf):
    return A.class_split_table(splits(spark, sf))


@register("agg3_mean_std_score",
          lambda: sql("SELECT split, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, "
                      "CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY split"))
def agg3(spark, sf):
    return A.mean_std(splits(spark, sf).withColumn("score", score()), "score", ["split"])


@register("agg4_rmse",
          lambda: sql("SELECT split, round(sqrt(avg(power(relevancia - score, 2))), 6) AS rmse, "
                      "CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY split"))
def agg4(spark, sf):
    return A.rmse(splits(spark, sf).withColumn("score", score()), "relevancia", "score", ["split"])


@register("agg5_monitor_cutoff",
          lambda: sql("SELECT m.max_date, CAST(count(c.doc_id) AS BIGINT) AS n_newer FROM "
                      f"(SELECT max(data_pub) AS max_date FROM splits WHERE split = 'train' AND data_pub < '{K.MONITOR_DATE}') m "
                      "LEFT JOIN classified c ON c.data_pub > m.max_date AND c.url IS NOT NULL "
                      "GROUP BY m.max_date"))
def agg5(spark, sf):
    max_date = (splits(spark, sf).filter((F.col("split") == "train") & (F.col("data_pub") < K.MONITOR_DATE))
                .agg(F.max("data_pub").alias("m")).first()["m"])
    newer = (cuts.drop_null_url(tables.classified(articles(spark, sf)))
             .filter(F.col("data_pub") > F.lit(max_date)))
    return newer.agg(F.count(F.lit(1)).cast("bigint").alias("n_newer")).select(
        F.lit(max_date).alias("max_date"), "n_newer")


@register("agg6_min_relevant_score",
          lambda: sql("SELECT split, round(min(score), 6) AS min_relevant_score FROM scored "
                      "WHERE relevancia IN (4, 5) GROUP BY split"))
def agg6(spark, sf):
    s = splits(spark, sf).withColumn("score", score())
    return (s.filter(F.col("relevancia").isin(4, 5)).groupBy("split")
            .agg(F.round(F.min("score"), 6).alias("min_relevant_score")))


@register("agg7_balanced_weights",
          lambda: sql("SELECT relevancia, round(raw / first_value(raw) OVER (ORDER BY relevancia), 6) "
                      "AS weight FROM (SELECT relevancia, sum(count(*)) OVER () / "
                      "(count(*) OVER () * count(*)) AS raw FROM splits WHERE split = 'train' "
                      "GROUP BY relevancia)"))
def agg7(spark, sf):
    return A.balanced_weights(splits(spark, sf).filter(F.col("split") == "train"))


_SQL_BOX = (
    "q AS (SELECT relevancia, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS med, "
    "quantile_cont(score, 0.75) AS q3 FROM scored GROUP BY relevancia)")


@register("agg8_box_summary",
          lambda: sql("SELECT s.relevancia, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, "
                      "round(any_value(q3), 6) AS q3, "
                      "round(min(CASE WHEN score >= q1 - 1.5 * (q3 - q1) THEN score END), 6) AS lower_whisker, "
                      "round(max(CASE WHEN score <= q3 + 1.5 * (q3 - q1) THEN score END), 6) AS upper_whisker, "
                      "CAST(count_if(score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS BIGINT) "
                      "AS n_outliers FROM scored s JOIN q USING (relevancia) GROUP BY s.relevancia",
                      _SQL_BOX))
def agg8(spark, sf):
    s = splits(spark, sf).withColumn("score", score())
    return A.box_summary(s, "score", "relevancia")


@register("agg9_histogram",
          lambda: sql(
              "SELECT b.bin, round(mn + b.bin * (mx - mn) / 40, 6) AS lo, "
              "round(mn + (b.bin + 1) * (mx - mn) / 40, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n "
              "FROM (SELECT CAST(range AS INT) AS bin FROM range(40)) b CROSS JOIN mm "
              "LEFT JOIN (SELECT CAST(least(floor((x - mn) / ((mx - mn) / 40)), 39) AS INT) AS bin, "
              "count(*) AS n FROM h CROSS JOIN mm GROUP BY 1) c ON b.bin = c.bin",
              "h AS (SELECT log10(1e-5 + abs(n_chars)) AS x FROM documents), "
              "mm AS (SELECT min(x) AS mn, max(x) AS mx FROM h)"))
def agg9(spark, sf):
    d = tables.table(spark, sf, "documents").select(
        F.log10(F.lit(1e-5) + F.abs(F.col("n_chars"))).alias("x"))
    return A.histogram(d, "x", 40)


@register("agg10_adjusted_r2",
          lambda: sql("SELECT CAST(count(*) AS BIGINT) AS n, round(1 - ssr / sst, 6) AS r2, "
                      "round(1 - (ssr / sst) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2 FROM ("
                      "SELECT *, sum(power(relevancia - score, 2)) OVER () AS ssr, "
                      "sum(relevancia * relevancia) OVER () - sum(relevancia) OVER () * sum(relevancia) OVER () "
                      "/ count(*) OVER () AS sst FROM scored WHERE split = 'val') GROUP BY ssr, sst"))
def agg10(spark, sf):
    s = splits(spark, sf).filter(F.col("split") == "val").withColumn("score", score())
    return A.adjusted_r2(s, "relevancia", "score", 1)


@register("agg12_max_depth",
          lambda: sql("SELECT CAST(max(len(string_split(orgao, '/'))) AS INT) AS max_levels FROM articles"))
def agg12(spark, sf):
    return articles(spark, sf).agg(F.max(T.count_levels("orgao")).cast("int").alias("max_levels"))
