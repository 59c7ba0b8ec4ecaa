"""TXT10 inside the normaliser: words stemmed at their place in the text.

The stemmer is any object with ``.stem(word)``. It runs once for each distinct word of all texts, in
Arrow batches; the stems come back to each distinct text as a map (bounded by the text's
distinct words) and take their words' places. Texts are keyed by hash, so copies are handled once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class SuffixStemmer:
    """Strips the longest of the given suffixes from words that stay ``least`` letters long."""

    def __init__(self, suffixes=("mente", "s"), least: int = 3):
        self.suffixes, self.least = tuple(suffixes), least
        ends = "|".join(re.escape(x) for x in sorted(self.suffixes, key=lambda x: (-len(x), x)))
        self.pattern = f"^(.{{{least},}}?)({ends})$"
        self._compiled = re.compile(self.pattern, re.S)

    def stem(self, word: str) -> str:
        return self._compiled.sub(r"\1", word)


def stem_words(df: DataFrame, text: str, out: str, stemmer) -> DataFrame:
    """``df`` with ``out``: the words of ``text`` stemmed and joined by one space; null stays null.

    ``stemmer=None`` only joins the words, as the reference's configured pipelines have none.
    """
    import pandas as pd
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    if stemmer is None:
        return df.withColumn(out, F.array_join(words, " "))

    def stems(s):
        return s.map(stemmer.stem)

    stems.__annotations__ = {"s": pd.Series, "return": pd.Series}
    keyed = df.withColumn("_words", words).withColumn("_key", F.sha2(F.col(text).cast("string"), 256))
    places = keyed.select("_key", F.explode(F.array_distinct("_words")).alias("_word")).distinct()
    dictionary = places.select("_word").distinct().withColumn("_stem", F.pandas_udf(stems, "string")("_word"))
    maps = places.join(dictionary, "_word").groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_stem"))).alias("_map"))
    joined = keyed.join(maps, "_key", "left")
    made = F.array_join(F.transform("_words", lambda w: F.element_at(F.col("_map"), w)), " ")
    return joined.withColumn(out, made).drop("_words", "_key", "_map")


def normalize_and_stem(df: DataFrame, text: str, out: str, stemmer, stopwords=None, **options) -> DataFrame:
    """TXT18 with its stemmer: after the stop words, before accents and letters are dropped."""
    last = {k: options.pop(k) for k in ("strip_accents", "only_letters") if k in options}
    none = {"lowercase": False, "value_tokens": False, "punctuation": False, "cargo_tokens": False}
    first = df.withColumn("_clean", T.normalize_text(text, stopwords=stopwords, strip_accents=False, only_letters=False, **options))
    stemmed = stem_words(first, "_clean", "_stemmed", stemmer)
    keep_cash = options.get("keep_cash", True)
    return stemmed.withColumn(out, T.normalize_text("_stemmed", keep_cash=keep_cash, **none, **last)).drop("_clean", "_stemmed")
