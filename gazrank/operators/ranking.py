"""Ranking metrics and curves (WIN*, TOP*).

Ordering is always explicit and total: ``score desc, id asc`` (descending
reading order) or ``score asc, id asc``.  Global positions and running sums
come from :func:`with_position` (range partitions + offsets), never from a
window without ``partitionBy``.  Metrics with a closed form avoid running
sums altogether:

* cumulative recall area ``A = sum over relevant (n - pos + 1) / (R n)``;
  the perfect area follows from the class counts alone;
* weighted inversions need, per row, the number of earlier rows of each
  label; labels are a handful of values, so that is one running sum per
  label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position

RELEVANT = (4, 5)


def _labels(df: DataFrame, label: str) -> list:
    """Distinct labels (an ordinal scale: a handful of values)."""
    return sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)


def _class_counts(df: DataFrame, label: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_c"))


def perfect_area(df: DataFrame, label: str, relevant=RELEVANT, group: list[str] | None = None) -> DataFrame:
    """Area under the perfect cumulative-recall curve (labels sorted desc),
    from class counts only: ``(group..., _n, _r, a_perfect)``."""
    group = list(group or [])
    cc = _class_counts(df, label, group)
    w_all = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w_before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        F.col(label).desc()).rowsBetween(Window.unboundedPreceding, -1)
    cc = (cc.withColumn("_n", F.sum("_c").over(w_all))
          .withColumn("_s", F.coalesce(F.sum("_c").over(w_before), F.lit(0)) + 1))
    is_rel = F.col(label).isin(*relevant)
    # sum over the block [s, s + c - 1] of (n + 1 - pos)
    block = F.col("_c") * (F.col("_n") + 1) - F.col("_c") * (2 * F.col("_s") + F.col("_c") - 1) / 2.0
    return cc.groupBy(*group).agg(
        F.first("_n").alias("_n"),
        F.sum(F.when(is_rel, F.col("_c")).otherwise(0)).alias("_r"),
        F.sum(F.when(is_rel, block).otherwise(0.0)).alias("_num"),
    ).withColumn("a_perfect", F.try_divide(F.col("_num"), F.col("_r") * F.col("_n"))).drop("_num")


def cum_recall_metric(df: DataFrame, label: str = "relevancia", score: str = "score",
                      id_col: str = "doc_id", relevant=RELEVANT,
                      group: list[str] | None = None, bounded_groups: bool = False) -> DataFrame:
    """WIN2: ``(A - 0.5) / (A_perfect - 0.5)`` per group; null if no relevant
    row.  ``bounded_groups``: groups are small (e.g. 200-row batches), so a
    per-group window gives positions; otherwise :func:`with_position`."""
    keys = list(group or [])
    if not keys:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    rel = F.col(label).isin(*relevant)
    narrow = df.select(*keys, id_col, label, score)
    order = [F.col(score).desc(), F.col(id_col).asc()]
    if bounded_groups:
        pos = narrow.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        pos = with_position(narrow, order, group=None if keys == ["_g"] else keys, name="_pos")
    contrib = pos.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(rel, 1).otherwise(0)).alias("_r"),
        F.sum(F.when(rel, F.col("_pos")).otherwise(0)).alias("_sp"))
    # A = sum (n + 1 - pos) / (R n) = (R (n + 1) - sum pos) / (R n)
    a = F.try_divide(F.col("_r") * (F.col("_n") + 1) - F.col("_sp"), F.col("_r") * F.col("_n"))
    contrib = contrib.withColumn("area", a)
    perf = perfect_area(df.select(*keys, label), label, relevant, keys).drop("_n", "_r")
    out = contrib.join(perf, keys)
    metric = F.when(F.col("_r") > 0, (F.col("area") - 0.5) / (F.col("a_perfect") - 0.5))
    return out.select(*(group or []), F.col("_n").cast("bigint").alias("n"),
                      F.col("_r").cast("bigint").alias("n_relevant"), metric.alias("cum_recall"))


def recall_curve(df: DataFrame, label: str = "relevancia", score: str = "score",
                 id_col: str = "doc_id", relevant=RELEVANT) -> DataFrame:
    """WIN1 + WIN7: per position: x = 100 i / n, model recall (cumulative
    share of relevant rows along score desc), perfect recall, random."""
    labels = _labels(df, label)
    counts = {r[label]: r["c"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    n = sum(counts.values())
    r_tot = sum(c for v, c in counts.items() if v in relevant)
    narrow = df.select(id_col, score, label).withColumn("_rel", F.col(label).isin(*relevant).cast("long"))
    pos = with_position(narrow, [F.col(score).desc(), F.col(id_col).asc()], name="pos", sums=["_rel"])
    # perfect order = labels descending: cumulative relevant count at i
    perfect = F.lit(0)
    start = 1
    for v in sorted(labels, reverse=True):
        c = counts[v]
        if v in relevant:
            perfect = perfect + F.least(F.greatest(F.col("pos") - start + 1, F.lit(0)), F.lit(c))
        start += c
    rt = float(r_tot) if r_tot else None
    return pos.select(
        "pos", id_col,
        (F.col("pos") * 100.0 / n).alias("x"),
        (F.col("cum__rel") / F.lit(rt)).alias("recall") if rt else F.lit(None).cast("double").alias("recall"),
        (perfect / F.lit(rt)).alias("perfect_recall") if rt else F.lit(None).cast("double").alias("perfect_recall"))


def inversion_counts(df: DataFrame, label: str = "relevancia", score: str = "score",
                     id_col: str = "doc_id") -> DataFrame:
    """WIN3 / WIN4: weighted inversions of labels read in ascending score
    order, ``sum over i < j of max(0, y_i - y_j)``, the maximum (labels sorted
    descending) and the ratio ``ranking_metric``."""
    labels = _labels(df, label)
    flags = {v: f"_f{i}" for i, v in enumerate(labels)}
    narrow = df.select(id_col, score, label, *[
        (F.col(label) == F.lit(v)).cast("long").alias(c) for v, c in flags.items()])
    pos = with_position(narrow, [F.col(score).asc(), F.col(id_col).asc()], name="_pos",
                        sums=list(flags.values()))
    contrib = F.lit(0)
    for v, c in flags.items():
        # earlier rows with a higher label v (cum includes the row itself,
        # which never has a label above its own)
        contrib = contrib + F.when(F.col(label) < F.lit(v),
                                   (F.lit(v) - F.col(label)) * F.col(f"cum_{c}")).otherwise(0)
    num = pos.agg(F.sum(contrib).alias("inversions"))
    cc = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()
    mx = 0
    for a in cc:
        for b in cc:
            if a[label] > b[label]:
                mx += (a[label] - b[label]) * a["c"] * b["c"]
    return num.select(F.col("inversions").cast("bigint").alias("inversions"),
                      F.lit(mx).cast("bigint").alias("max_inversions"),
                      (F.col("inversions") / F.lit(float(mx) if mx else None)).alias("ranking_metric"))


def moving_average(pos_df: DataFrame, value: str, window: int, pos: str = "pos") -> DataFrame:
    """WIN5: mean of the ``window`` values ending at each position; only full
    windows (the first ``window - 1`` positions are dropped).

    ``pos_df`` carries a global 1-based position and ``cum_<value>``; the
    value ``window`` positions earlier is found by an equi-join on position.
    """
    prev = pos_df.select((F.col(pos) + window).alias(pos), F.col(f"cum_{value}").alias("_prev"))
    j = pos_df.filter(F.col(pos) >= window).join(prev, pos, "left")
    return j.withColumn("moving_avg", (F.col(f"cum_{value}") - F.coalesce(F.col("_prev"), F.lit(0)))
                        / float(window))


def average_rank_series(df: DataFrame, label: str = "relevancia", score: str = "score",
                        id_col: str = "doc_id", window: int = 20) -> DataFrame:
    """WIN6: labels in descending score order, moving average, x from 0 to
    100, and the random-order band ``mean +- sqrt((m2 - mean^2) / window)``."""
    narrow = df.select(id_col, score, F.col(label).cast("double").alias("_y"))
    pos = with_position(narrow, [F.col(score).desc(), F.col(id_col).asc()], name="pos", sums=["_y"])
    n = df.count()
    m = n - window + 1
    mom = df.agg(F.avg(F.col(label).cast("double")).alias("mu"),
                 F.avg(F.col(label).cast("double") ** 2).alias("m2")).first()
    mu, m2 = float(mom["mu"]), float(mom["m2"])
    dev = ((m2 - mu * mu) / window) ** 0.5
    ma = moving_average(pos, "_y", window)
    x = (F.col("pos") - window) * 100.0 / F.lit(float(max(m - 1, 1)))
    return ma.select("pos", x.alias("x"), F.col("moving_avg").alias("avg_label"),
                     F.lit(mu).alias("random_mean"), F.lit(mu - dev).alias("random_lo"),
                     F.lit(mu + dev).alias("random_hi"))


def forward_difference(pos_df: DataFrame, value: str, pos: str = "pos", dx: float = 1.0) -> DataFrame:
    """WIN11: ``d_i = (y_{i+1} - y_i) / dx``; the last point is extrapolated
    ``2 d_{n-1} - d_{n-2}`` (differences of the last three points)."""
    nxt = pos_df.select((F.col(pos) - 1).alias(pos), F.col(value).alias("_next"))
    j = pos_df.join(nxt, pos, "left")
    n = pos_df.agg(F.max(pos)).first()[0]
    tail = {r[pos]: r[value] for r in pos_df.filter(F.col(pos) >= n - 2).select(pos, value).collect()}
    last = None
    if n is not None and n >= 3:
        d1 = tail[n] - tail[n - 1]
        d0 = tail[n - 1] - tail[n - 2]
        last = 2 * d1 - d0
    d = F.when(F.col("_next").isNotNull(), F.col("_next") - F.col(value)).otherwise(F.lit(last))
    return j.select(pos, value, (d / dx).alias("derivative"))


def threshold_curve(df: DataFrame, label: str = "relevancia", score: str = "score",
                    relevant=RELEVANT) -> DataFrame:
    """WIN9 / WIN10: per distinct score (descending) the counts at or above
    it and precision, recall, false-positive rate."""
    rel = F.col(label).isin(*relevant)
    per = df.groupBy(score).agg(F.sum(rel.cast("long")).alias("_tp"),
                                F.sum((~rel).cast("long")).alias("_fp"))
    tot = df.agg(F.sum(rel.cast("long")).alias("p"), F.sum((~rel).cast("long")).alias("q")).first()
    p, q = float(tot["p"] or 0), float(tot["q"] or 0)
    pos = with_position(per, [F.col(score).desc()], name="_k", sums=["_tp", "_fp"])
    tp, fp = F.col("cum__tp"), F.col("cum__fp")
    return pos.select(F.col(score).alias("threshold"), tp.cast("bigint").alias("tp"),
                      fp.cast("bigint").alias("fp"),
                      (tp / (tp + fp)).alias("precision"),
                      (tp / F.lit(p if p else None)).alias("recall"),
                      (fp / F.lit(q if q else None)).alias("fpr"))


def worst_predictions(df: DataFrame, label: str, pred: str, id_col: str, k: int) -> DataFrame:
    """TOP1: largest absolute errors (``TakeOrderedAndProject``: a top-k per
    partition, then a merge of k rows per partition)."""
    d = df.withColumn("diff", F.col(pred) - F.col(label)).withColumn("abs_diff", F.abs("diff"))
    return d.orderBy(F.col("abs_diff").desc(), F.col(id_col).asc()).limit(k)


def kth(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """TOP4: the row at 0-based rank ``k`` (``iloc[k]`` after a sort)."""
    return df.orderBy(*order).limit(k + 1).withColumn(
        "_r", F.row_number().over(Window.orderBy(*order))).filter(F.col("_r") == k + 1).drop("_r")
