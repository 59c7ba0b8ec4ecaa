"""Near copies of a large group, whose shared 5-grams have a low idf."""

import random

from gazrank.llm import queries as Q


def test_copies_of_a_large_group(spark, tmp_path):
    # By idf weights the copies of a group of 60 in 560 texts are under 0.8 alike, by their distinct 5-grams over it.
    rng = random.Random(41)
    base = [f"b{i}" for i in range(200)]
    rows = [" ".join(base)]
    for k in range(59):
        words = list(base)
        for i in (20, 60, 100, 140):
            words[i + k % 13] = f"new{k}of{i}"
        rows.append(" ".join(words))
    rows += [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(500)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in Q.op9_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(560)}
