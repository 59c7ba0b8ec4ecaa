"""Distributed global positions and top-k against brute force, including a
hot value holding a third of all rows."""

import random

from pyspark.sql import functions as F

from gazrank.operators.ordering import top_k_per_group, with_position


def _data(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        score = 0.5 if i % 3 == 0 else rnd.random()      # a third tie on one value
        rows.append((i, float(score), rnd.randint(1, 5)))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, score double, label int")


def test_with_position_matches_sort(spark):
    rows, df = _data(spark)
    pos = with_position(df, [F.col("score").desc(), F.col("id").asc()], name="p", sums=["label"])
    got = {r["id"]: (r["p"], r["cum_label"]) for r in pos.collect()}
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    acc = 0
    for i, (id_, _, lab) in enumerate(ordered, start=1):
        acc += lab
        assert got[id_] == (i, acc)


def test_with_position_groups(spark):
    rows, df = _data(spark)
    pos = with_position(df, ["score", "id"], group=["label"], name="p")
    got = {r["id"]: r["p"] for r in pos.collect()}
    for lab in range(1, 6):
        sub = sorted([r for r in rows if r[2] == lab], key=lambda r: (r[1], r[0]))
        for i, r in enumerate(sub, start=1):
            assert got[r[0]] == i


def test_top_k_per_group(spark):
    rows, df = _data(spark)
    top = top_k_per_group(df, ["label"], [F.col("score").desc(), F.col("id").asc()], 7, salt_col="id")
    got = sorted((r["label"], r["rank"], r["id"]) for r in top.collect())
    want = []
    for lab in range(1, 6):
        sub = sorted([r for r in rows if r[2] == lab], key=lambda r: (-r[1], r[0]))[:7]
        want += [(lab, i, r[0]) for i, r in enumerate(sub, start=1)]
    assert got == sorted(want)
