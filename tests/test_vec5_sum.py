"""VEC5's sums read the entries of the sparse vectors, not an array as long as the vocabulary in each row."""

from gazrank.plans import registry


def test_no_dense_rows(spark):
    df = registry.queries()["vec5_multicolumn_sum"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().analyzed().toString().lower().replace("_", "")
    assert "unwrapudt" in plan
    rows = df.collect()
    assert rows and all(r.n_terms > 0 and r.sum_v >= r.max_v > 0 for r in rows)
