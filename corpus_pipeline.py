"""The corpus pipeline: stages over the table ``documents``, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazrank.llm import common, decontamination, line_dedup, near_dup, pieces, quality_rules, sentencepiece_codec
from gazrank.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(quality_rules.judge(docs, model)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten different documents (ids) or more go; texts and lengths change."""
    out = line_dedup.drop_repeated_lines(docs, count_ids=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id."""
    return near_dup.drop_copies(docs, sets=True).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go."""
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as piece ids."""
    out = sentencepiece_codec.encode(docs, pieces.load(PIECE_MODEL), keep=["doc_id", "lang", "source", "n_chars"])
    return out.select("*", F.size("ids").cast("long").alias("n_ids"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates),
          ("decontamination", decontaminate), ("sentencepiece", encode)]

#: The models of the first and later stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; every result but the last is a written table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
