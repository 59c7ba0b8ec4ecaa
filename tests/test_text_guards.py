"""Post patterns that are tried only where they can match give what all of them one after the other give."""

import random

from pyspark.sql import functions as F

from gazrank import constants as K
from gazrank.functions import text as T


def test_guarded_patterns_equal_all_patterns(spark):
    rnd = random.Random(6)
    parts = ["DAS 101.6", "das-102.4", "daſ 103.1", "das", "CA i", "ca-ii", "ca", "ca-apo 1", "CDT", "ccd ii", "Cge-iv", "CPAGLO", "csp", "(cSu)",
             "cd 1", "cd.2", "CD", "ne", "NE", "cetgİv", "cetg vi", "fds1", "fcpe 101.3", "FPE-222.5", "pe", "natureza especial", "Natureza",
             "cne 07", "CNE-12", "i", "1", "2", ".6", " ", "  ", "-", ",", "\n", "é", "x", "ção", "K", "İ", "ı", "ſ"]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "-"]) for _ in range(rnd.randint(0, 8)))) for i in range(6000)]
    df = spark.createDataFrame([*rows, (-1, None)], "id long, text string").repartition(8)
    all_of_them = F.col("text")
    for pat, tok in K.CARGO_PATTERNS:
        all_of_them = T.regex_sub_ci(all_of_them, pat, tok)
    letters = T.collapse_ws(F.regexp_replace("text", T._letters_class(True), ""))
    got = df.select("text", all_of_them.alias("a"), T.tokenize_cargos("text").alias("b"), letters.alias("c"), T.keep_only_letters("text").alias("d")).collect()
    assert [(r.text, r.b) for r in got if r.a != r.b] == [] and [(r.text, r.d) for r in got if r.c != r.d] == []
    assert sum(r.text is not None and r.a != r.text for r in got) > 3000


def test_patterns_of_other_literals_are_left_out():
    needs = T._cargo_groups(K.CARGO_PATTERNS)
    assert sum(len(rows) for _, rows in needs) == len(K.CARGO_PATTERNS)
    assert sum(len(rows) for ls, rows in needs if not ls) == 1
