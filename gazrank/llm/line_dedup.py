"""Line deduplication by document frequency.

Method: explode each document's distinct normalised lines, hash them, count
the documents per hash (pre-aggregated before the shuffle), keep the hashes at
or over the threshold, find the positions where they occur, and rebuild every
text from its remaining lines by position.

Scale: the count shuffles one row per distinct hash and map task, or with ``count_ids`` one per id and hash. The frequent
hashes are a written table, so Spark broadcasts them only if their files are
under its own threshold, and otherwise joins by hash (a hot line's rows are
then split by the adaptive skew join). Only positions are grouped, never
lines; a text moves once, for the join with its own positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return C.ascii_lower(F.btrim(line, F.lit(C.SPACE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits, so that different lines stay apart at any size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text",
                   id_col: str | None = None) -> DataFrame:
    """Hashes (h1, h2) of the keys of ``min_chars`` code points or more in ``min_docs`` rows (with ``id_col``: ids) or more."""
    keys = F.array_distinct(F.transform(text_lines(F.col(text)), line_key))
    ids = [F.col(id_col).alias("id")] if id_col else []
    found = (docs.select(*ids, F.explode(keys).alias("k")).filter(F.char_length("k") >= min_chars)
             .select(*["id"] * len(ids), *_hashes(F.col("k"))))
    return ((found.distinct() if ids else found)
            .groupBy("h1", "h2").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_docs).select("h1", "h2"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                        id_col: str = "doc_id", text: str = "text", count_ids: bool = False) -> DataFrame:
    """Input columns plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    * null or empty text: one empty line; ``kept_text`` is the empty string.
    * every row counts as a document, so repeated rows count each (with ``count_ids``
      every id, so they count once), and each row comes back; a null id is a value like any other.
    * keys shorter than ``min_chars`` are never dropped.
    * an empty table gives an empty table; input columns named like the new
      ones are replaced by them, all others pass through.
    """
    frequent = C.stored(frequent_lines(docs, min_docs, min_chars, text, id_col if count_ids else None), "lines")
    keyed = docs.select(*C.row_key(F.col(id_col), F.col(text)), F.struct(*docs.columns).alias("row"))
    at = (keyed.select("rk1", "rk2", F.posexplode(F.transform(text_lines(F.col("row")[text]), line_key)).alias("pos", "k"))
          .filter(F.char_length("k") >= min_chars)
          .select("rk1", "rk2", "pos", *_hashes(F.col("k"))))
    dropped = (at.join(frequent, ["h1", "h2"])
               .groupBy("rk1", "rk2").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    joined = keyed.join(dropped, ["rk1", "rk2"], "left").select(
        "row", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # One flag per line up to the last dropped one, then blank the flagged lines; array_join leaves nulls out.
    flags = F.flatten(F.transform("gone", lambda p, i: F.concat(
        F.array_repeat(F.lit(False), p - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    lines = text_lines(F.col("row")[text])
    kept = F.array_join(F.zip_with(lines, flags, lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line)), "\n")
    return joined.select(*C.with_new(docs.columns, {
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.size("gone").cast("long"), "kept_text": kept}))
