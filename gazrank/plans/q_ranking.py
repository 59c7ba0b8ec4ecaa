"""Registered queries: ranking metrics, curves and top-k (WIN*, TOP*).

The score is the deterministic stand-in ``common.score()`` so that both
engines rank the same values; model predictions use the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import aggregates as A
from ..operators import ranking as RK
from ..operators.ordering import with_position
from ..operators import vectorize as V
from .common import score, splits, sql
from .registry import register
from .q_vectors import _sql_sec2, section2_model_terms

REL = "relevancia IN (4, 5)"


def scored(spark, sf):
    return splits(spark, sf).withColumn("score", score())


# ----------------------------------------------------------------- WIN2

_SQL_WIN2 = (
    "p AS (SELECT split, relevancia, row_number() OVER (PARTITION BY split ORDER BY score DESC, doc_id) AS pos, "
    "count(*) OVER (PARTITION BY split) AS n FROM scored), "
    f"a AS (SELECT split, any_value(n) AS n, count_if({REL}) AS r, "
    f"sum(CASE WHEN {REL} THEN n - pos + 1 ELSE 0 END) AS s FROM p GROUP BY split), "
    "pp AS (SELECT split, relevancia, row_number() OVER (PARTITION BY split ORDER BY relevancia DESC, doc_id) "
    "AS pos, count(*) OVER (PARTITION BY split) AS n FROM scored), "
    f"ap AS (SELECT split, sum(CASE WHEN {REL} THEN n - pos + 1 ELSE 0 END) AS sp FROM pp GROUP BY split)")


@register("win2_cum_recall_by_split",
          lambda: sql("SELECT split, CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS n_relevant, "
                      "round(CASE WHEN r > 0 THEN (s / (r * n) - 0.5) / (sp / (r * n) - 0.5) END, 6) "
                      "AS cum_recall FROM a JOIN ap USING (split)", _SQL_WIN2))
def win2(spark, sf):
    """Headline metric: normalised area under the cumulative-recall curve."""
    m = RK.cum_recall_metric(scored(spark, sf), group=["split"])
    return m.select("split", "n", "n_relevant", F.round("cum_recall", 6).alias("cum_recall"))


_SQL_WIN2_ALL = (
    "p AS (SELECT relevancia, row_number() OVER (ORDER BY score DESC, doc_id) AS pos, "
    "count(*) OVER () AS n FROM scored), "
    f"a AS (SELECT any_value(n) AS n, count_if({REL}) AS r, "
    f"sum(CASE WHEN {REL} THEN n - pos + 1 ELSE 0 END) AS s FROM p), "
    "pp AS (SELECT relevancia, row_number() OVER (ORDER BY relevancia DESC, doc_id) AS pos, "
    "count(*) OVER () AS n FROM scored), "
    f"ap AS (SELECT sum(CASE WHEN {REL} THEN n - pos + 1 ELSE 0 END) AS sp FROM pp)")


@register("win2_cum_recall_overall",
          lambda: sql("SELECT CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS n_relevant, "
                      "round(CASE WHEN r > 0 THEN (s / (r * n) - 0.5) / (sp / (r * n) - 0.5) END, 6) "
                      "AS cum_recall FROM a, ap", _SQL_WIN2_ALL))
def win2_all(spark, sf):
    """WIN2 over all labelled rows (global positions, no grouping)."""
    m = RK.cum_recall_metric(scored(spark, sf))
    return m.select("n", "n_relevant", F.round("cum_recall", 6).alias("cum_recall"))


# ----------------------------------------------------------------- WIN1 / WIN7 / WIN11

_SQL_CURVE = (
    f"m AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos, "
    f"sum(CASE WHEN {REL} THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cr, "
    f"count(*) OVER () AS n, count_if({REL}) OVER () AS r FROM scored), "
    f"pf AS (SELECT row_number() OVER (ORDER BY relevancia DESC, doc_id) AS pos, "
    f"sum(CASE WHEN {REL} THEN 1 ELSE 0 END) OVER (ORDER BY relevancia DESC, doc_id ROWS UNBOUNDED PRECEDING) "
    "AS cp FROM scored), "
    "curve AS (SELECT m.pos, m.doc_id, m.pos * 100.0 / n AS x, cr / r AS recall, cp / r AS perfect_recall "
    "FROM m JOIN pf USING (pos))")


@register("win1_recall_curve",
          lambda: sql("SELECT CAST(pos AS BIGINT) AS pos, doc_id, round(x, 6) AS x, round(recall, 6) AS recall, "
                      "round(perfect_recall, 6) AS perfect_recall FROM curve", _SQL_CURVE))
def win1(spark, sf):
    """WIN1 cumulative relevant share + WIN7 recall-curve table."""
    c = RK.recall_curve(scored(spark, sf))
    return c.select(F.col("pos").cast("bigint").alias("pos"), "doc_id", F.round("x", 6).alias("x"),
                    F.round("recall", 6).alias("recall"),
                    F.round("perfect_recall", 6).alias("perfect_recall"))


@register("win11_recall_derivative",
          lambda: sql(
              "SELECT CAST(pos AS BIGINT) AS pos, round(coalesce(lead(recall) OVER (ORDER BY pos) - recall, "
              "(SELECT 2 * (max(CASE WHEN pos = n THEN recall END) - max(CASE WHEN pos = n - 1 THEN recall END)) "
              "- (max(CASE WHEN pos = n - 1 THEN recall END) - max(CASE WHEN pos = n - 2 THEN recall END)) "
              "FROM curve, (SELECT count(*) AS n FROM curve))), 6) AS derivative FROM curve", _SQL_CURVE))
def win11(spark, sf):
    """WIN11: forward difference of the recall curve, last point extrapolated."""
    c = RK.recall_curve(scored(spark, sf))
    d = RK.forward_difference(c.select("pos", "recall"), "recall")
    return d.select(F.col("pos").cast("bigint").alias("pos"), F.round("derivative", 6).alias("derivative"))


# ----------------------------------------------------------------- WIN3 / WIN4


@register("win4_ranking_metric",
          lambda: sql(
              "SELECT CAST(inv AS BIGINT) AS inversions, CAST(mx AS BIGINT) AS max_inversions, "
              "round(inv / mx, 6) AS ranking_metric FROM "
              "(SELECT sum(greatest(a.y - b.y, 0)) AS inv FROM p a JOIN p b ON a.pos < b.pos), "
              "(SELECT sum((a.relevancia - b.relevancia) * a.c * b.c) AS mx FROM c a JOIN c b "
              "ON a.relevancia > b.relevancia)",
              "p AS (SELECT relevancia AS y, row_number() OVER (ORDER BY score, doc_id) AS pos FROM scored), "
              "c AS (SELECT relevancia, count(*) AS c FROM scored GROUP BY relevancia)"))
def win4(spark, sf):
    """WIN3 weighted inversions along ascending score, WIN4 their ratio to
    the maximum (running per-label counts, no pair enumeration)."""
    r = RK.inversion_counts(scored(spark, sf))
    return r.select("inversions", "max_inversions", F.round("ranking_metric", 6).alias("ranking_metric"))


# ----------------------------------------------------------------- WIN5 / WIN6


@register("win5_moving_average",
          lambda: sql("SELECT CAST(pos AS BIGINT) AS pos, round(ma, 6) AS moving_avg FROM (SELECT "
                      "row_number() OVER (ORDER BY score DESC, doc_id) AS pos, avg(relevancia) OVER "
                      "(ORDER BY score DESC, doc_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma "
                      "FROM scored) WHERE pos >= 5"))
def win5(spark, sf):
    s = scored(spark, sf).select("doc_id", "score", F.col("relevancia").cast("double").alias("y"))
    pos = with_position(s, [F.col("score").desc(), F.col("doc_id").asc()], name="pos", sums=["y"])
    ma = RK.moving_average(pos, "y", 5)
    return ma.select(F.col("pos").cast("bigint").alias("pos"), F.round("moving_avg", 6).alias("moving_avg"))


@register("win6_average_rank_series",
          lambda: sql(
              "SELECT CAST(pos AS BIGINT) AS pos, round((pos - 20) * 100.0 / (n - 20), 6) AS x, "
              "round(ma, 6) AS avg_label, round(mu, 6) AS random_mean, round(mu - sqrt((m2 - mu * mu) / 20), 6) "
              "AS random_lo, round(mu + sqrt((m2 - mu * mu) / 20), 6) AS random_hi FROM (SELECT "
              "row_number() OVER (ORDER BY score DESC, doc_id) AS pos, count(*) OVER () AS n, "
              "avg(relevancia) OVER (ORDER BY score DESC, doc_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma, "
              "avg(relevancia) OVER () AS mu, avg(relevancia * relevancia) OVER () AS m2 FROM scored) "
              "WHERE pos >= 20"))
def win6(spark, sf):
    r = RK.average_rank_series(scored(spark, sf), window=20)
    return r.select(F.col("pos").cast("bigint").alias("pos"), *[
        F.round(c, 6).alias(c) for c in ["x", "avg_label", "random_mean", "random_lo", "random_hi"]])


# ----------------------------------------------------------------- WIN8

_SAMPLE_BEFORE = "2021-01-01"

_SQL_DRIFT = (
    f"cut AS (SELECT max(data_pub) AS m FROM splits WHERE split = 'train' AND data_pub < '{_SAMPLE_BEFORE}'), "
    "nw AS (SELECT *, (row_number() OVER (ORDER BY data_pub, doc_id) - 1) // 200 AS batch FROM scored "
    "WHERE data_pub > (SELECT m FROM cut)), "
    "bp AS (SELECT batch, relevancia, row_number() OVER (PARTITION BY batch ORDER BY score DESC, doc_id) AS pos, "
    "row_number() OVER (PARTITION BY batch ORDER BY relevancia DESC, doc_id) AS ppos, "
    "count(*) OVER (PARTITION BY batch) AS n FROM nw), "
    f"bm AS (SELECT batch, count_if({REL}) AS r, any_value(n) AS n, "
    f"sum(CASE WHEN {REL} THEN n - pos + 1 ELSE 0 END) AS s, "
    f"sum(CASE WHEN {REL} THEN n - ppos + 1 ELSE 0 END) AS sp FROM bp GROUP BY batch)")


@register("win8_drift_monitor",
          lambda: sql(
              "SELECT CAST(nw.batch AS BIGINT) AS batch, min(data_pub) AS first_date, max(data_pub) AS last_date, "
              "CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(power(relevancia - score, 2))), 6) AS rmse, "
              "round(any_value(CASE WHEN r > 0 THEN (s / (r * bm.n) - 0.5) / (sp / (r * bm.n) - 0.5) END), 6) "
              "AS cum_recall FROM nw JOIN bm USING (batch) GROUP BY nw.batch", _SQL_DRIFT))
def win8(spark, sf):
    """WIN8: rows newer than the saved sample, by date, in 200-row batches:
    date range, RMSE and cumulative recall per batch."""
    sc = scored(spark, sf)
    cutoff = (sc.filter((F.col("split") == "train") & (F.col("data_pub") < _SAMPLE_BEFORE))
              .agg(F.max("data_pub")).first()[0])
    new = sc.filter(F.col("data_pub") > F.lit(cutoff)).select("doc_id", "data_pub", "relevancia", "score")
    pos = with_position(new, ["data_pub", "doc_id"], name="_p")
    b = pos.withColumn("batch", F.floor((F.col("_p") - 1) / K.DRIFT_BATCH).cast("bigint")).drop("_p")
    stats = b.groupBy("batch").agg(
        F.min("data_pub").alias("first_date"), F.max("data_pub").alias("last_date"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.sqrt(F.avg(F.pow(F.col("relevancia") - F.col("score"), 2))), 6).alias("rmse"))
    cr = RK.cum_recall_metric(b, group=["batch"], bounded_groups=True).select(
        "batch", F.round("cum_recall", 6).alias("cum_recall"))
    return stats.join(cr, "batch")


# ----------------------------------------------------------------- WIN9 / WIN10


@register("win9_precision_recall_curve",
          lambda: sql(
              "SELECT round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
              "round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(fp / q, 6) AS fpr FROM ("
              "SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(fp) OVER (ORDER BY score DESC) AS fp, "
              "sum(tp) OVER () AS p, sum(fp) OVER () AS q FROM "
              f"(SELECT score, count_if({REL}) AS tp, count_if(NOT ({REL})) AS fp FROM scored GROUP BY score))"))
def win9(spark, sf):
    """WIN9 precision-recall and WIN10 ROC points per score threshold."""
    c = RK.threshold_curve(scored(spark, sf))
    return c.select(F.round("threshold", 6).alias("threshold"), "tp", "fp",
                    *[F.round(x, 6).alias(x) for x in ["precision", "recall", "fpr"]])


@register("win10_roc_nearest_zero",
          lambda: sql(
              "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ("
              "SELECT score - 3 AS threshold, sum(fp) OVER (ORDER BY score DESC) / sum(fp) OVER () AS fpr, "
              "sum(tp) OVER (ORDER BY score DESC) / sum(tp) OVER () AS tpr FROM "
              f"(SELECT score, count_if({REL}) AS tp, count_if(NOT ({REL})) AS fp FROM scored GROUP BY score)) "
              "ORDER BY abs(threshold), threshold DESC LIMIT 1"))
def win10(spark, sf):
    """WIN10: the ROC point whose decision threshold is nearest 0 (decision
    value = score - 3)."""
    c = RK.threshold_curve(scored(spark, sf).withColumn("score", F.col("score") - 3.0))
    best = c.orderBy(F.abs("threshold"), F.col("threshold").desc()).limit(1)
    return best.select(F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"),
                       F.round("recall", 6).alias("tpr"))


# ----------------------------------------------------------------- TOP


@register("top1_worst_predictions",
          lambda: sql("SELECT doc_id, relevancia, round(score, 6) AS score, round(score - relevancia, 6) AS diff, "
                      "round(abs(score - relevancia), 6) AS abs_diff FROM scored "
                      "ORDER BY abs(score - relevancia) DESC, doc_id LIMIT 20"))
def top1(spark, sf):
    w = RK.worst_predictions(scored(spark, sf), "relevancia", "score", "doc_id", 20)
    return w.select("doc_id", "relevancia", F.round("score", 6).alias("score"),
                    F.round("diff", 6).alias("diff"), F.round("abs_diff", 6).alias("abs_diff"))


@register("top2_lowest_relevant",
          lambda: sql(f"SELECT doc_id, relevancia, round(score, 6) AS score FROM scored WHERE {REL} "
                      "ORDER BY score, doc_id LIMIT 10"))
def top2(spark, sf):
    s = scored(spark, sf).filter(F.col("relevancia").isin(*K.RELEVANT_LABELS))
    return (s.orderBy("score", "doc_id").limit(10)
            .select("doc_id", "relevancia", F.round("score", 6).alias("score")))


def term_weights(spark, sf):
    """Deterministic token weight: mean label of train documents holding the
    term minus the train mean (a stand-in for model coefficients)."""
    docs, terms, vocab = section2_model_terms(spark, sf)
    tr = docs.filter(F.col("split") == "train").select("doc_id", "relevancia")
    mean = tr.agg(F.avg("relevancia")).first()[0]
    j = V.restrict(terms, vocab).join(tr, "doc_id")
    return j.groupBy("term").agg((F.avg("relevancia") - F.lit(mean)).alias("weight")).withColumn(
        "abs_weight", F.abs("weight"))


_SQL_TW = ("tw AS (SELECT term, avg(relevancia) - (SELECT avg(relevancia) FROM splits WHERE split = 'train') "
           "AS weight FROM tv WHERE split = 'train' GROUP BY term)")


@register("top3_top_terms_by_weight",
          lambda: sql("SELECT term, round(weight, 6) AS weight, round(abs(weight), 6) AS abs_weight FROM tw "
                      "ORDER BY abs(weight) DESC, term LIMIT 20", _sql_sec2(_SQL_TW)))
def top3(spark, sf):
    w = term_weights(spark, sf)
    return (w.orderBy(F.col("abs_weight").desc(), F.col("term").asc()).limit(20)
            .select("term", F.round("weight", 6).alias("weight"), F.round("abs_weight", 6).alias("abs_weight")))


@register("top4_kth_smallest_term",
          lambda: sql("SELECT term, round(weight, 6) AS weight FROM tw ORDER BY weight, term LIMIT 1 OFFSET 14",
                      _sql_sec2(_SQL_TW)))
def top4(spark, sf):
    w = term_weights(spark, sf)
    k = RK.kth(w, [F.col("weight").asc(), F.col("term").asc()], 14)
    return k.select("term", F.round("weight", 6).alias("weight"))


def given_weights(spark, sf):
    """Token weights with a stand-in importance: the share of relevant documents, of terms in five or more; else 0."""
    docs, terms, vocab = section2_model_terms(spark, sf)
    tr = docs.filter(F.col("split") == "train").select("doc_id", "relevancia")
    mean = tr.agg(F.avg("relevancia")).first()[0]
    rel = F.avg(F.col("relevancia").isin(*K.RELEVANT_LABELS).cast("double"))
    j = V.restrict(terms, vocab).join(tr, "doc_id").groupBy("term")
    return j.agg((F.avg("relevancia") - F.lit(mean)).alias("weight"),
                 F.when(F.count(F.lit(1)) >= 5, rel).otherwise(F.lit(0.0)).alias("importance")).withColumn("abs_weight", F.abs("weight"))


_SQL_GW = ("gw AS (SELECT term, avg(relevancia) - (SELECT avg(relevancia) FROM splits WHERE split = 'train') AS weight, "
           "CASE WHEN count(*) >= 5 THEN avg(CASE WHEN relevancia IN (4, 5) THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS importance "
           "FROM tv WHERE split = 'train' GROUP BY term)")


@register("top3_top_terms_by_importance",
          lambda: sql("SELECT term, round(importance, 6) AS importance, round(weight, 6) AS weight FROM gw WHERE abs(weight) >= 0.05 "
                      "ORDER BY importance DESC, term LIMIT 20", _sql_sec2(_SQL_GW)))
def top3_importance(spark, sf):
    """TOP3, second list: the most important of the tokens with an absolute weight of 0.05 or more."""
    w = given_weights(spark, sf).filter(F.col("abs_weight") >= 0.05)
    return w.orderBy(F.col("importance").desc(), F.col("term").asc()).limit(20).select(
        "term", F.round("importance", 6).alias("importance"), F.round("weight", 6).alias("weight"))


@register("agg9_unimportant_weight_histogram",
          lambda: sql("SELECT b.bin, round(mn + b.bin * (mx - mn) / 40, 6) AS lo, round(mn + (b.bin + 1) * (mx - mn) / 40, 6) AS hi, "
                      "CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(40)) b CROSS JOIN mm "
                      "LEFT JOIN (SELECT CAST(least(floor((x - mn) / ((mx - mn) / 40)), 39) AS INT) AS bin, "
                      "count(*) AS n FROM h CROSS JOIN mm GROUP BY 1) c ON b.bin = c.bin",
                      _sql_sec2(_SQL_GW + ", h AS (SELECT log10(1e-5 + abs(weight)) AS x FROM gw WHERE abs(importance) <= 1e-8), "
                                "mm AS (SELECT min(x) AS mn, max(x) AS mx FROM h)")))
def agg9_weights(spark, sf):
    """AGG9: log weights of the tokens whose importance is close to 0, in 40 bins."""
    w = given_weights(spark, sf).filter(F.abs("importance") <= 1e-8)
    return A.histogram(w.select(F.log10(F.lit(1e-5) + F.col("abs_weight")).alias("x")), "x", 40)
