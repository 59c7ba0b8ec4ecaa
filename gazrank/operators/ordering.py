"""Global order without a single task.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Here a global position is built in two levels instead:

1. ``repartitionByRange(P, keys)`` + ``sortWithinPartitions(keys)``, then a
   reliable ``checkpoint()``: the range bounds are sampled, so the frame is
   materialised once and both uses below (local index, per-partition
   counts) read exactly the same partitions.  The key always ends with a
   unique id, so ties (even one value holding a third of all rows) are split
   over many ranges.  Pass a narrow frame (keys, id, summed columns).
2. ``monotonically_increasing_id`` gives each row its index inside the
   partition; the per-partition counts (at most P + G rows, G = number of
   groups) are turned into offsets by a window over that tiny table and
   joined back.

Everything is JVM-side and deterministic, so lost executors recompute the
same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

_LOW_BITS = (1 << 33) - 1


def _sort_cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(df: DataFrame, order: list, group: list[str] | None = None,
                  name: str = "_pos", sums: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Add a 1-based position (within ``group`` if given) along ``order``.

    ``order`` must make a total order (end it with the id).  ``sums``: for
    each named numeric column ``c`` add ``cum_<c>``, the running sum up to
    and including the row (same order, same group).  ``group`` must have few
    distinct values (labels, batches); use :func:`top_k_per_group` for
    per-entity rankings.
    """
    group = list(group or [])
    sums = list(sums or [])
    spark = df.sparkSession
    p = partitions or shuffle_partitions(spark)
    keys = [F.col(g).asc_nulls_first() for g in group] + _sort_cols(order)
    # Materialised once: range bounds come from sampling, and two
    # re-executions may sample differently, so both uses below must read
    # the same partitions.
    # The range sampling reads its input too; the narrow input is written
    # first so that whatever made it (joins, a model) runs once.
    r = materialize(materialize(df).repartitionByRange(p, *keys).sortWithinPartitions(*keys))
    r = (r.withColumn("_pid", F.spark_partition_id())
         .withColumn("_lidx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_lidx").alias("_first")]
    aggs += [F.sum(c).alias(f"_s_{c}") for c in sums]
    cnt = r.groupBy("_pid", *group).agg(*aggs)
    wprev = (Window.partitionBy(*group).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(wprev), F.lit(0)))
    for c in sums:
        cnt = cnt.withColumn(f"_soff_{c}", F.coalesce(F.sum(f"_s_{c}").over(wprev), F.lit(0)))
    cnt = cnt.drop("_n", *[f"_s_{c}" for c in sums])
    # Without groups the offsets table has at most P rows: a proven bound.
    cnt_side = F.broadcast(cnt) if not group else cnt
    out = r.join(cnt_side, ["_pid", *group], "inner")
    out = out.withColumn(name, (F.col("_off") + F.col("_lidx") - F.col("_first") + 1).cast("long"))
    if sums:
        wloc = (Window.partitionBy("_pid", *group).orderBy("_lidx")
                .rowsBetween(Window.unboundedPreceding, 0))
        for c in sums:
            out = out.withColumn(f"cum_{c}", F.col(f"_soff_{c}") + F.sum(c).over(wloc))
        out = out.drop(*[f"_soff_{c}" for c in sums])
    return out.drop("_pid", "_lidx", "_first", "_off")


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int,
                    name: str = "rank", salt_buckets: int | None = None,
                    salt_col: str | None = None) -> DataFrame:
    """Top ``k`` rows per group along ``order`` (a total order), with rank.

    Two phases so a hot group (a third of all rows) is not sorted in one
    task: first the top ``k`` inside (group, salt) buckets, where the salt
    is a hash of ``salt_col`` (or of the order columns), then the top ``k``
    among at most ``salt_buckets * k`` survivors per group (as many buckets as
    shuffle partitions, unless given).  Exact: a global
    top-k row is a top-k row of its bucket.
    """
    cols = _sort_cols(order)
    salt_buckets = salt_buckets or shuffle_partitions(df.sparkSession)
    salt_src = F.col(salt_col) if salt_col else F.concat_ws(
        "\u0001", *[F.col(c).cast("string") for c in order if isinstance(c, str)])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*cols)
    first = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*cols)
    return (first.drop("_salt", "_r1").withColumn(name, F.row_number().over(w2))
            .filter(F.col(name) <= k))
