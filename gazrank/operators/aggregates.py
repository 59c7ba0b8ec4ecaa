"""Aggregations (AGG*).

All aggregates are declarative ``groupBy().agg()`` (partial aggregation
before the shuffle).  Quantiles are exact without collecting a group into
one buffer: positions come from :func:`with_position` and only the two rows
around each quantile are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position


def class_frequency(df: DataFrame, label: str = "relevancia") -> DataFrame:
    """AGG1: count and relative frequency per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    # one row per class: the total is a window over a handful of rows
    w = Window.partitionBy(F.lit(0))
    return counts.withColumn("freq", F.round(F.col("n") / F.sum("n").over(w), 6))


def class_split_table(df: DataFrame, label: str = "relevancia", split: str = "split",
                      splits=("train", "val", "test")) -> DataFrame:
    """AGG2: class x split counts over the full class list (classes seen in
    any split), with ``all_present`` flagging classes missing somewhere."""
    piv = df.groupBy(label).pivot(split, list(splits)).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in splits]
    out = piv.select(label, *cols)
    present = None
    for s in splits:
        c = F.col(f"n_{s}") > 0
        present = c if present is None else present & c
    return out.withColumn("all_present", present)


def mean_std(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """AGG3: mean and population std."""
    g = df.groupBy(*(group or []))
    return g.agg(F.round(F.avg(value), 6).alias("mean"),
                 F.round(F.stddev_pop(value), 6).alias("std"),
                 F.count(F.lit(1)).cast("bigint").alias("n"))


def rmse(df: DataFrame, y: str, p: str, group: list[str] | None = None) -> DataFrame:
    """AGG4."""
    return df.groupBy(*(group or [])).agg(
        F.round(F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))), 6).alias("rmse"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def balanced_weights(df: DataFrame, label: str = "relevancia") -> DataFrame:
    """AGG7: ``n / (k * count_c)``, scaled so the first present class has
    weight 1 (classes absent from the data are not emitted)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # counts has one row per class: the window runs over a handful of rows
    raw = (F.sum("c").over(w) / (F.count(F.lit(1)).over(w) * F.col("c")))
    out = counts.withColumn("_raw", raw)
    return out.select(label, F.round(F.col("_raw") / F.first("_raw").over(w), 6).alias("weight"))


def exact_quantiles(df: DataFrame, value: str, group: str, probs: list[float],
                    id_col: str = "doc_id") -> DataFrame:
    """Linear-interpolated quantiles per group (numpy / ``quantile_cont``)."""
    pos = with_position(df.select(group, value, id_col), [value, id_col], group=[group], name="_p")
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    at = pos.select(group, "_p", F.col(value).alias("_v"))
    outs = []
    for q in probs:
        h = (F.col("_n") - 1) * F.lit(q)
        lo = n.withColumn("_h", h).withColumn("_lo", F.floor("_h").cast("long") + 1)
        lo = lo.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n")))
        a = at.withColumnRenamed("_p", "_lo").withColumnRenamed("_v", "_vlo")
        b = at.withColumnRenamed("_p", "_hi").withColumnRenamed("_v", "_vhi")
        j = lo.join(a, [group, "_lo"]).join(b, [group, "_hi"])
        val = F.col("_vlo") + (F.col("_h") - (F.col("_lo") - 1)) * (F.col("_vhi") - F.col("_vlo"))
        outs.append(j.select(group, F.lit(q).alias("q"), val.alias("value")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def box_summary(df: DataFrame, value: str, group: str, id_col: str = "doc_id") -> DataFrame:
    """AGG8: quartiles, whiskers (last point within 1.5 IQR) and outliers."""
    qs = exact_quantiles(df, value, group, [0.25, 0.5, 0.75], id_col)
    wide = qs.groupBy(group).pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.select(group, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"),
                       F.col("`0.75`").alias("q3"))
    # one row per group: small side of the join
    j = df.select(group, value).join(wide, group)
    iqr = F.col("q3") - F.col("q1")
    lo_lim = F.col("q1") - 1.5 * iqr
    hi_lim = F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return j.groupBy(group).agg(
        F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("median"), 6).alias("median"),
        F.round(F.first("q3"), 6).alias("q3"),
        F.round(F.min(F.when(v >= lo_lim, v)), 6).alias("lower_whisker"),
        F.round(F.max(F.when(v <= hi_lim, v)), 6).alias("upper_whisker"),
        F.count_if((v < lo_lim) | (v > hi_lim)).cast("bigint").alias("n_outliers"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """AGG9: equal-width histogram over [min, max]; max falls in the last bin.

    min / max are a one-row aggregate read as two scalars; the bin index is
    a plain expression, so counting is a partial aggregate by bin.
    """
    spark = df.sparkSession
    mm = df.agg(F.min(value).alias("mn"), F.max(value).alias("mx")).first()
    mn, mx = float(mm["mn"]), float(mm["mx"])
    width = (mx - mn) / bins
    if width == 0:
        idx = F.lit(0)
    else:
        idx = F.least(F.floor((F.col(value) - F.lit(mn)) / F.lit(width)), F.lit(bins - 1))
    counts = df.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left")
    return out.select("bin",
                      F.round(F.lit(mn) + F.col("bin") * F.lit(width), 6).alias("lo"),
                      F.round(F.lit(mn) + (F.col("bin") + 1) * F.lit(width), 6).alias("hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def adjusted_r2(df: DataFrame, y: str, p: str, n_features: int, w: str | None = None) -> DataFrame:
    """AGG10: weighted R^2 and ``1 - (1 - r2)(n - 1)/(n - p - 1)``."""
    wc = F.col(w).cast("double") if w else F.lit(1.0)
    s = df.agg(F.sum(wc).alias("sw"), F.sum(wc * F.col(y)).alias("swy"),
               F.sum(wc * F.col(y) * F.col(y)).alias("swyy"),
               F.sum(wc * F.pow(F.col(y) - F.col(p), 2)).alias("ssr"),
               F.count(F.lit(1)).alias("n"))
    sst = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    r2 = 1 - F.col("ssr") / sst
    return s.select(F.col("n").cast("bigint").alias("n"), F.round(r2, 6).alias("r2"),
                    F.round(1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - n_features - 1), 6)
                    .alias("adj_r2"))
