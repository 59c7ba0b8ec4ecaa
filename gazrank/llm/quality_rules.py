"""Quality rules: hashed n-gram log-likelihood ratio, DataFrame functions only.

Word uni- and bigrams are hashed into a fixed number of buckets (the model's
size, a parameter). Two multinomials over the buckets, one of trusted
documents and one of the whole corpus, are counted over all rows; a document's
score is the mean of log(p_trusted / p_corpus) over its n-grams. Every
document is judged by a fixed threshold on it; nothing is sampled.

Scale: the counts are pre-aggregated, so at most one row per bucket and task
is shuffled. Only the model (``buckets`` numbers) passes the driver; it returns to the
executors as a constant. Documents are scored in place, with no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 18
PRIOR = 60.0
THRESHOLD = -0.15
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.WORD), F.lit(0))


def _hashed(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``w`` (words), then ``h`` (a hash for each word)."""
    return df.withColumn("w", words(text)).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _buckets(h: Column, n: int) -> Column:
    """Bucket of each unigram, then of each bigram, of an array of word hashes."""
    ones = F.transform(h, lambda x: F.pmod(x, F.lit(n)).cast("int"))
    nexts = F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), nexts,
                       lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n)).cast("int"))
    return F.concat(ones, pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids all of whose labels say good quality and not toxic; null ids or labels do not count."""
    return (labels.groupBy("doc_id").agg(F.min(F.col("quality")).alias("q"), F.max(F.col("toxic")).alias("t"))
            .filter("doc_id is not null and q = 1 and t = 0").select("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR,
        id_col: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000) -> list[float]:
    """Log ratio of each bucket. Without a trusted document all are 0.

    The trusted multinomial has a Dirichlet prior of ``prior`` n-grams a bucket
    around the corpus one, so that a bucket seen a few times says little.
    """
    ids = C.small_side(trusted_ids(labels), broadcast_rows)
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(
        ids.select(F.col("doc_id").alias("id"), F.lit(1).alias("good")), "id", "left")
    counts = (_hashed(flagged, F.col("t")).select(F.explode(_buckets(F.col("h"), buckets)).alias("b"), "good")
              .groupBy("b").agg(F.count("*").alias("n"), F.count("good").alias("g")).collect())
    raw, good = sum(r["n"] for r in counts), sum(r["g"] for r in counts)
    if not good:
        return [0.0] * buckets
    share = good / raw
    out = [0.0] * buckets
    for r in counts:
        out[r["b"]] = math.log((r["g"] + prior * share) / ((r["n"] + prior) * share))
    return out


def _model(weights: list[float]) -> Column:
    """The model as one constant array (folded once, when the query is planned)."""
    return F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")


def judge(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Input columns plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, score (null without words) and kept.

    * null or empty text: no words, all counts 0, base_failed, not kept.
    * repeated rows are judged alike, one by one; ids are not looked at.
    * a score equal to the threshold is kept.
    * input columns named like the new ones are replaced; an empty table gives
      an empty table.
    """
    n, size = len(weights), F.size("h")
    t = F.coalesce(F.col("row")[text], F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _hashed(docs.select(F.struct(*docs.columns).alias("row")), F.col("row")[text])
    df = df.withColumn("windows", F.when(size >= WINDOW, F.transform(
        F.sequence(F.lit(1), size - WINDOW + 1), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")))
    # Only a text in which some window comes twice needs the sort that finds where.
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
        F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("sorted", lambda s, j: (F.get("sorted", j - 1)["x"].eqNullSafe(s["x"]))
                     | (F.get("sorted", j + 1)["x"].eqNullSafe(s["x"])))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda s: s["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    model = _model(weights)
    total = F.aggregate(_buckets(F.col("h"), n), F.lit(0.0), lambda a, b: a + F.get(model, b))
    df = df.select(
        "row", size.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(size > 0, total / (2 * size - 1)).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    new = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return df.select(*C.with_new(docs.columns, new | {
        "base_failed": failed, "score": F.col("score"), "kept": ~failed & (F.col("score") >= threshold)}))


def keep_good(judged: DataFrame) -> DataFrame:
    """The rows of :func:`judge` that are kept.

    The row number, which is never negative, keeps the optimizer from moving
    the condition below the steps of ``judge``, where their shared parts would be written
    out, and so evaluated, once for each use.
    """
    numbered = judged.withColumn("row_number", F.monotonically_increasing_id())
    return numbered.filter(F.col("kept") & (F.col("row_number") >= 0)).drop("row_number")
