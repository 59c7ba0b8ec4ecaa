"""Registered queries: splits and sampling (SPL*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import splits as S
from ..operators.ordering import with_position
from .common import base, sql
from .registry import register

_SHUF = S.sql_shuffle_key("doc_id", 42)
_POS = f"row_number() OVER (ORDER BY {_SHUF}, doc_id)"


@register("spl1_shuffled_positions",
          lambda: sql(f"SELECT doc_id, CAST({_POS} AS BIGINT) AS pos FROM base"))
def spl1(spark, sf):
    return S.shuffled_positions(base(spark, sf)).select("doc_id", "pos")


_FRACS = [0.7, 0.15, 0.15]


@register("spl2_exact_size_sets",
          lambda: sql(
              "SELECT doc_id, CASE WHEN pos <= s0 THEN 0 WHEN pos <= s0 + s1 THEN 1 ELSE 2 END AS set_id "
              "FROM p CROSS JOIN (SELECT n - s1 - s2 AS s0, s1, s2 FROM (SELECT count(*) AS n, "
              "round_even(count(*) * 0.15, 0) AS s1, round_even(count(*) * 0.15, 0) AS s2 FROM base))",
              f"p AS (SELECT doc_id, {_POS} AS pos FROM base)"))
def spl2(spark, sf):
    return S.random_set_split(base(spark, sf), _FRACS, seed=42).select(
        "doc_id", F.col("set_id").cast("int").alias("set_id"))


def _sql_in_test(frac, prefix, col="url"):
    return f"{T.sql_hash_string(col, prefix)} < {frac * S.TWO32!r}"


@register("spl3_hash_split",
          lambda: sql(f"SELECT doc_id, {_sql_in_test(K.TEST_FRAC, K.TEST_PREFIX)} AS is_test FROM base"))
def spl3(spark, sf):
    return base(spark, sf).select(
        "doc_id", S.in_test_by_string("url", K.TEST_FRAC, K.TEST_PREFIX).alias("is_test"))


@register("spl4_nested_hash_split", lambda: sql("SELECT doc_id, relevancia, split FROM splits"))
def spl4(spark, sf):
    return base(spark, sf).select("doc_id", "relevancia", S.nested_split_label("url").alias("split"))


_DATE = "2020-07-30"


@register("spl5_date_split",
          lambda: sql(f"SELECT doc_id, 'train' AS part FROM base WHERE data_pub < '{_DATE}' UNION ALL "
                      f"SELECT doc_id, 'test' AS part FROM base WHERE data_pub >= '{_DATE}'"))
def spl5(spark, sf):
    tr, te = S.split_by_date(base(spark, sf), "data_pub", _DATE)
    return (tr.select("doc_id", F.lit("train").alias("part"))
            .unionByName(te.select("doc_id", F.lit("test").alias("part"))))


@register("spl6_date_then_hash_split",
          lambda: sql(f"SELECT doc_id, CASE WHEN data_pub < '{_DATE}' THEN 'train' WHEN "
                      f"{_sql_in_test(0.5, K.TEST_PREFIX)} THEN 'test' ELSE 'val' END AS part "
                      f"FROM base WHERE data_pub IS NOT NULL"))
def spl6(spark, sf):
    tr, va, te = S.split_by_date_and_string(base(spark, sf), "data_pub", _DATE, "url", K.TEST_PREFIX)
    return (tr.select("doc_id", F.lit("train").alias("part"))
            .unionByName(va.select("doc_id", F.lit("val").alias("part")))
            .unionByName(te.select("doc_id", F.lit("test").alias("part"))))


_STRAT_SQL = (
    "c AS (SELECT relevancia, count(*) AS ck FROM base GROUP BY relevancia), "
    "t AS (SELECT sum(ck) AS n, CAST(ceil(0.2 * sum(ck)) AS BIGINT) AS nt FROM c), "
    "r AS (SELECT relevancia, ck * nt / n AS raw, floor(ck * nt / n) AS fl, nt FROM c CROSS JOIN t), "
    "a AS (SELECT relevancia, fl + CASE WHEN row_number() OVER (ORDER BY raw - fl DESC, relevancia) "
    "<= nt - sum(fl) OVER () THEN 1 ELSE 0 END AS alloc FROM r), "
    f"p AS (SELECT doc_id, relevancia, row_number() OVER (PARTITION BY relevancia ORDER BY {_SHUF}, doc_id) "
    "AS cpos FROM base)")


@register("spl7_stratified_split",
          lambda: sql("SELECT doc_id, relevancia, cpos <= alloc AS is_test FROM p JOIN a USING (relevancia)",
                      _STRAT_SQL))
def spl7(spark, sf):
    tr, te = S.stratified_split(base(spark, sf), "relevancia", 0.2, seed=42)
    return (tr.select("doc_id", "relevancia", F.lit(False).alias("is_test"))
            .unionByName(te.select("doc_id", "relevancia", F.lit(True).alias("is_test"))))


def _sql_kfold(order):
    return sql(
        "SELECT doc_id, CAST(CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1)) "
        "ELSE r + floor((pos - r * (q + 1)) / q) END AS INTEGER) AS fold FROM "
        f"(SELECT doc_id, row_number() OVER (ORDER BY {order}) - 1 AS pos, "
        "count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS r FROM base)")


@register("spl8_kfold_contiguous", lambda: _sql_kfold("doc_id"))
def spl8(spark, sf):
    return S.with_kfold(base(spark, sf), 5).select("doc_id", "fold")


@register("spl8_kfold_shuffled",
          lambda: _sql_kfold(f"{S.sql_shuffle_key('doc_id', K.SHUFFLE_SEED)}, doc_id"))
def spl8s(spark, sf):
    return S.with_kfold(base(spark, sf), 5, seed=K.SHUFFLE_SEED).select("doc_id", "fold")


@register("spl12_sample_per_class",
          lambda: sql(f"SELECT doc_id, relevancia, sample_rank FROM (SELECT doc_id, relevancia, "
                      f"CAST(row_number() OVER (PARTITION BY relevancia ORDER BY {_SHUF}, doc_id) AS INT) "
                      "AS sample_rank FROM base) WHERE sample_rank <= 5"))
def spl12(spark, sf):
    out = S.sample_per_group(base(spark, sf), "relevancia", 5)
    return out.select("doc_id", "relevancia", F.col("sample_rank").cast("int").alias("sample_rank"))


@register("spl13_learning_curve_prefixes",
          lambda: sql(
              "SELECT CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_rows, "
              "CAST(count_if(relevancia IN (4, 5)) AS BIGINT) AS n_relevant, "
              "round(avg(relevancia), 6) AS mean_label FROM "
              "(SELECT range AS size FROM (SELECT count(*) AS n, CAST(floor(count(*) / 10) AS BIGINT) AS d "
              "FROM base) m, range(m.d, m.n + 1, m.d)) s JOIN p ON p.pos <= s.size GROUP BY size",
              f"p AS (SELECT doc_id, relevancia, {_POS} AS pos FROM base)"))
def spl13(spark, sf):
    b = base(spark, sf).withColumn("_rel", F.col("relevancia").isin(*K.RELEVANT_LABELS).cast("long"))
    n = b.count()
    sizes = S.learning_curve_sizes(n, 10)
    keyed = b.select("doc_id", "relevancia", "_rel").withColumn("_key", S.shuffle_key("doc_id", 42))
    pos = with_position(keyed, ["_key", "doc_id"], name="size", sums=["relevancia", "_rel"])
    return pos.filter(F.col("size").isin(sizes)).select(
        F.col("size").cast("bigint").alias("size"), F.col("size").cast("bigint").alias("n_rows"),
        F.col("cum__rel").cast("bigint").alias("n_relevant"),
        F.round(F.col("cum_relevancia") / F.col("size"), 6).alias("mean_label"))
