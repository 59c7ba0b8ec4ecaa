"""Helpers shared by the operators: scratch tables, row keys, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character list and as regular expressions.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one that ``spark.checkpoint.dir`` names.

    Only a plain local session without that setting gets a temporary folder;
    elsewhere executors could not read it, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a reread, and every later reader
    sees the same rows. With ``free`` the write's shuffle files go at its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= max_rows else df


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the values: never null, equal for equal rows."""
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in ((11, "rk1"), (23, "rk2"))]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII strings take the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_new(row_cols: list[str], new: dict[str, Column], row: str = "row") -> list[Column]:
    """The input columns kept in the struct ``row``, then the new ones.

    A new column takes the place of an input column of its name.
    """
    taken = {n.lower() for n in new}
    return [F.col(row)[c].alias(c) for c in row_cols if c.lower() not in taken] + [
        c.alias(n) for n, c in new.items()]
