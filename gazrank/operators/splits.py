"""Reproducible splits and sampling (SPL*).

Hash splits are pure row-wise filters (no shuffle).  Random permutations are
engine independent: rows are ordered by ``md5(seed || ':' || id)``, never by
``rand()``, so Spark, DuckDB and a re-run after executor loss agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .ordering import with_position

TWO32 = float(2 ** 32)


def in_test_by_string(col: str, test_frac: float, prefix: str = "") -> Column:
    """SPL3: test iff ``crc32(id without prefix) < test_frac * 2**32``."""
    return T.hash_string(col, prefix) < F.lit(test_frac * TWO32)


def split_by_string(df: DataFrame, test_frac: float, col: str = "url",
                    prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """SPL3: (train, test).  Null ids must be removed first (FLT6)."""
    t = in_test_by_string(col, test_frac, prefix)
    return df.filter(~t), df.filter(t)


def nested_split_label(col: str = "url") -> Column:
    """SPL4: 'test' (15 %, first prefix), else 'val' (17 %, second prefix),
    else 'train'.  The two prefixes give two independent hash inputs."""
    return (F.when(in_test_by_string(col, K.TEST_FRAC, K.TEST_PREFIX), F.lit("test"))
            .when(in_test_by_string(col, K.VAL_FRAC, K.VAL_PREFIX), F.lit("val"))
            .otherwise(F.lit("train")))


def sql_nested_split_label(col: str = "url") -> str:
    t = f"{T.sql_hash_string(col, K.TEST_PREFIX)} < {K.TEST_FRAC * TWO32!r}"
    v = f"{T.sql_hash_string(col, K.VAL_PREFIX)} < {K.VAL_FRAC * TWO32!r}"
    return f"CASE WHEN {t} THEN 'test' WHEN {v} THEN 'val' ELSE 'train' END"


def split_by_date(df: DataFrame, date_col: str, test_min_date: str) -> tuple[DataFrame, DataFrame]:
    """SPL5: ``< d`` train, ``>= d`` test; null dates in neither."""
    c = F.col(date_col)
    return df.filter(c < test_min_date), df.filter(c >= test_min_date)


def split_by_date_and_string(df: DataFrame, date_col: str, min_test_date: str, str_col: str,
                             prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SPL6: past = train; future split 50/50 by hash into val and test."""
    train, future = split_by_date(df, date_col, min_test_date)
    val, test = split_by_string(future, 0.5, str_col, prefix)
    return train, val, test


def shuffle_key(id_col: str = "doc_id", seed: int = 42) -> Column:
    """Engine-independent shuffle key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sql_shuffle_key(id_col: str = "doc_id", seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_col} AS VARCHAR))"


def shuffled_positions(df: DataFrame, id_col: str = "doc_id", seed: int = 42,
                       name: str = "pos") -> DataFrame:
    """SPL1: seeded permutation; ``pos`` is 1-based.

    Positions are computed on the narrow ``(id, key)`` frame and joined back
    by id, so wide rows (full texts) are never range-partitioned.
    """
    narrow = df.select(id_col).withColumn("_key", shuffle_key(id_col, seed))
    pos = with_position(narrow, ["_key", id_col], name=name).drop("_key")
    return df.join(pos, id_col)


def set_sizes(n: int, fracs: list[float]) -> list[int]:
    """SPL2 sizes: ``round_half_even(n * f)``, first set takes the rest."""
    if not math.isclose(sum(fracs), 1.0):
        raise ValueError("fractions must add up to one")
    sizes = [round(n * f) for f in fracs]  # Python round is half-even
    sizes[0] = n - sum(sizes[1:])
    return sizes


def random_set_split(df: DataFrame, fracs: list[float], seed: int = 42,
                     id_col: str = "doc_id", name: str = "set_id") -> DataFrame:
    """SPL2: exact-size disjoint complete sets (``set_id`` 0..k-1)."""
    n = df.count()
    sizes = set_sizes(n, fracs)
    pos = shuffled_positions(df, id_col, seed, name="_spos")
    bounds, acc = [], 0
    for s in sizes:
        acc += s
        bounds.append(acc)
    expr = None
    for i, b in enumerate(bounds):
        cond = F.col("_spos") <= b
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return pos.withColumn(name, expr).drop("_spos")


def stratified_allocation(counts: dict, test_size: float) -> dict:
    """Largest-remainder allocation of ``ceil(test_size * n)`` test rows."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n) if test_size < 1 else int(test_size)
    raw = {k: c * n_test / n for k, c in counts.items()}
    alloc = {k: int(math.floor(v)) for k, v in raw.items()}
    rest = n_test - sum(alloc.values())
    for k in sorted(raw, key=lambda k: (-(raw[k] - alloc[k]), k))[:rest]:
        alloc[k] += 1
    return alloc


def stratified_split(df: DataFrame, label: str, test_size: float, seed: int = 42,
                     id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """SPL7: exact stratified split, one shuffle.

    Class counts are a tiny aggregate (one row per class); positions inside
    each class come from :func:`with_position`, so a hot class is spread
    over many tasks.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    alloc = stratified_allocation(counts, test_size)
    narrow = df.select(id_col, label).withColumn("_key", shuffle_key(id_col, seed))
    pos = with_position(narrow, ["_key", id_col], group=[label], name="_cpos").drop("_key", label)
    pos = df.join(pos, id_col)
    lim = None
    for k, a in alloc.items():
        cond = F.col(label) == F.lit(k)
        lim = F.when(cond, F.lit(a)) if lim is None else lim.when(cond, F.lit(a))
    is_test = F.col("_cpos") <= lim
    return pos.filter(~is_test).drop("_cpos"), pos.filter(is_test).drop("_cpos")


def kfold_column(pos: Column, n: int, k: int) -> Column:
    """SPL8: fold id of a 0-based position; first ``n % k`` folds one longer."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    return (F.when(pos < big, F.floor(pos / (q + 1)))
            .otherwise(F.lit(r) + F.floor((pos - big) / max(q, 1)))).cast("int")


def with_kfold(df: DataFrame, k: int, id_col: str = "doc_id", seed: int | None = None,
               name: str = "fold") -> DataFrame:
    """SPL8: contiguous folds over id order (or a seeded shuffle)."""
    n = df.count()
    if seed is None:
        pos = df.join(with_position(df.select(id_col), [id_col], name="_kpos"), id_col)
    else:
        pos = shuffled_positions(df, id_col, seed, name="_kpos")
    return pos.withColumn(name, kfold_column(F.col("_kpos") - 1, n, k)).drop("_kpos")


def learning_curve_sizes(n: int, steps: int) -> list[int]:
    """SPL13: ``range(d, n + 1, d)`` with ``d = int(n / steps)``."""
    d = int(n / steps)
    if d == 0:
        raise ValueError("more steps than rows")
    return list(range(d, n + 1, d))


def sample_per_group(df: DataFrame, group: str, k: int, id_col: str = "doc_id",
                     seed: int = 42) -> DataFrame:
    """SPL12: k pseudo-random rows per group (md5 order, salted top-k)."""
    from .ordering import top_k_per_group
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    return top_k_per_group(keyed, [group], ["_key", id_col], k, name="sample_rank",
                           salt_col=id_col).drop("_key")
