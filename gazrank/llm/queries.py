"""The registered queries of these operators and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (common, conversation_repair, decontamination, line_dedup, lm_scoring, near_dup, periodic_runs, pieces,
               quality_rules, repeated_bytes, sentencepiece_codec, substring_dedup, token_counts, url_rules, warc)

#: Parameter of the contract: the list rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The table of pages has no dates.
CRAWL_DATE = "2024-01-01T00:00:00Z"
#: Vocabulary of the token queries; the file is read on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark, sf_dir):
    source = warc.responses(table(spark, sf_dir, "pages"), F.lit(CRAWL_DATE))
    made = warc.derivatives(source, keep=["source_key", "target_uri", "date"])
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("conversion_record", "metadata_record")]
    return made.select(F.col("source_key").alias("page_id"), "target_uri", "date", "conversion_id", "metadata_id", "refers_to",
                       "source_block_digest", "source_payload_digest", "text_digest",
                       F.length("text").cast("long").alias("text_chars"), "n_links", *digests)


def op2_url_rules(spark, sf_dir):
    out = url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, count_ids=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontamination(spark, sf_dir):
    out = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "pos", "n_tokens", "item_tokens", "n_slots", "n_changed")


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces.load(PIECE_MODEL), keep=["doc_id"])


def op8_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_minhash_near_dedup(spark, sf_dir):
    out = near_dup.classes(table(spark, sf_dir, "documents"), sets=True)
    return out.select("doc_id", "class_id", F.col("leads").alias("kept"))


def op10_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), pieces.load(PIECE_MODEL), keep=["doc_id"], check=True)


def op11_repeated_bytes(spark, sf_dir):
    out = repeated_bytes.drop_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def damaged(rows):
    """Rows of conversations with the contract's damage, by crc32 of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), way.alias("way")).filter("way <> 0")
    return marked.select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    made = conversation_repair.report(damaged(rows))
    every = rows.select(F.col("conv_id").alias("every")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(made, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def periodic(docs):
    """Documents with the contract's planted periods, by crc32 of ``doc_id``."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(common.WORD), F.lit(0))))
    sized = chosen.withColumn("n", F.size("words").cast("long")).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn(
        "p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    words = F.transform("words", lambda w, i: F.when(i >= a, F.get("words", (a + (i - a) % p).cast("int"))).otherwise(w))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    out = periodic_runs.find_runs(periodic(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (often.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (often.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY doc_id
"""

QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_url_rules, op3_substring_dedup, op4_lm_scoring, op5_line_dedup, op6_decontamination, op7_token_counts, op8_quality_rules,
                                  op9_minhash_near_dedup, op10_sentencepiece, op11_repeated_bytes, op12_conversation_repair, op13_periodic_runs)}
ORACLES = {"op5_line_dedup": OP5_SQL}
