"""Registered queries: text and hash expressions (TXT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import preprocess as P
from ..operators.stemming import SuffixStemmer, normalize_and_stem
from ..sources import tables
from .common import articles, base, sql
from .registry import register


def _digest(col, name):
    # a null text has length -1 (keeps the integer column free of nulls)
    return [F.md5(col).alias(f"{name}_md5"),
            F.coalesce(F.length(col).cast("bigint"), F.lit(-1).cast("bigint")).alias(f"{name}_len")]


def _sql_digest(expr, name):
    return f"md5({expr}) AS {name}_md5, CAST(coalesce(length({expr}), -1) AS BIGINT) AS {name}_len"


@register("txt1_edition_type",
          lambda: sql(f"SELECT doc_id, {T.sql_edition_type('edicao')} AS tipo_edicao FROM articles"))
def txt1(spark, sf):
    return articles(spark, sf).select("doc_id", T.edition_type("edicao").alias("tipo_edicao"))


@register("txt2_article_type",
          lambda: sql(f"SELECT doc_id, {T.sql_article_type('identifica')} AS titulo FROM articles"))
def txt2(spark, sf):
    return articles(spark, sf).select("doc_id", T.article_type("identifica").alias("titulo"))


@register("txt3_count_levels",
          lambda: sql("SELECT doc_id, CAST(len(string_split(orgao, '/')) AS INT) AS n_levels FROM articles "
                      "WHERE orgao IS NOT NULL"))
def txt3(spark, sf):
    a = articles(spark, sf).filter(F.col("orgao").isNotNull())
    return a.select("doc_id", T.count_levels("orgao").cast("int").alias("n_levels"))


# The adapter's organisation paths are at most three levels deep at every
# scale, so the SQL text lists three level columns; Spark fits the depth.
_LEVELS_SQL = 3


@register("txt4_level_columns",
          lambda: sql(P.sql_preprocess_articles(["orgaos"], fillna=K.NULL_TOKEN, keep=["doc_id"],
                                                n_levels=_LEVELS_SQL)))
def txt4(spark, sf):
    return P.preprocess_articles(articles(spark, sf), ["orgaos"], fillna=K.NULL_TOKEN,
                                 keep=["doc_id"])


_TXT7_COLS = ["titulo", "tipo_edicao", "secao", "ementa_text", "tit_ementa_text",
              "tit_org_ementa_text", "org_ementa_text"]


def _sql_txt7(fill):
    inner = P.sql_preprocess_articles(_TXT7_COLS, fillna=fill, keep=["doc_id"])
    return sql("SELECT doc_id, titulo, tipo_edicao, secao, "
               + ", ".join(_sql_digest(c, c) for c in _TXT7_COLS[3:])
               + f" FROM ({inner})")


def _txt7(spark, sf, fill):
    pre = P.preprocess_articles(articles(spark, sf), _TXT7_COLS, fillna=fill, keep=["doc_id"])
    digests = [d for c in _TXT7_COLS[3:] for d in _digest(F.col(c), c)]
    return pre.select("doc_id", "titulo", "tipo_edicao", "secao", *digests)


@register("txt7_preprocess_articles_filled", lambda: _sql_txt7(K.NULL_TOKEN))
def txt7_filled(spark, sf):
    """TXT5 + TXT6 + TXT7 with the notebook null token."""
    return _txt7(spark, sf, K.NULL_TOKEN)


@register("txt6_joined_texts_null_propagating", lambda: _sql_txt7(None))
def txt6_nofill(spark, sf):
    """TXT6 without fill: any null part makes the joined text null."""
    return _txt7(spark, sf, None)


def _on_text(spark, sf, fn, name="out"):
    a = articles(spark, sf)
    return a.select("doc_id", *_digest(fn(F.col("fulltext")), name))


def _sql_on_text(fn, name="out"):
    return sql(f"SELECT doc_id, {_sql_digest(fn('fulltext'), name)} FROM articles")


@register("txt8_remove_punctuation", lambda: _sql_on_text(T.sql_remove_punctuation))
def txt8(spark, sf):
    return _on_text(spark, sf, T.remove_punctuation)


@register("txt9_remove_stopwords",
          lambda: _sql_on_text(lambda e: T.sql_remove_stopwords(f"lower({e})", K.portuguese_stopwords())))
def txt9(spark, sf):
    return _on_text(spark, sf, lambda c: T.remove_stopwords(F.lower(c), K.portuguese_stopwords()))


@register("txt11_remove_accents", lambda: _sql_on_text(T.sql_remove_accents))
def txt11(spark, sf):
    return _on_text(spark, sf, T.remove_accents)


@register("txt12_keep_only_letters", lambda: _sql_on_text(T.sql_keep_only_letters))
def txt12(spark, sf):
    return _on_text(spark, sf, T.keep_only_letters)


@register("txt13_num_to_scale",
          lambda: sql(f"SELECT doc_id, {T.sql_num_to_scale('n_chars')} AS scale FROM documents"))
def txt13(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", T.num_to_scale("n_chars").alias("scale"))


@register("txt15_values_to_token", lambda: _sql_on_text(T.sql_values_to_token))
def txt15(spark, sf):
    return _on_text(spark, sf, T.values_to_token)


@register("txt17_cargo_tokens", lambda: _sql_on_text(T.sql_tokenize_cargos))
def txt17(spark, sf):
    return _on_text(spark, sf, T.tokenize_cargos)


@register("txt20_clean_certified", lambda: _sql_on_text(T.sql_clean_certified))
def txt20(spark, sf):
    return _on_text(spark, sf, T.clean_certified)


@register("txt19_lowercase", lambda: _sql_on_text(lambda e: f"lower({e})"))
def txt19(spark, sf):
    return _on_text(spark, sf, F.lower)


@register("txt21_hash_string",
          lambda: sql(f"SELECT doc_id, {T.sql_hash_string('url', K.TEST_PREFIX)} AS h_test, "
                      f"{T.sql_hash_string('url', K.VAL_PREFIX)} AS h_val FROM articles "
                      "WHERE url IS NOT NULL"))
def txt21(spark, sf):
    a = articles(spark, sf).filter(F.col("url").isNotNull())
    return a.select("doc_id", T.hash_string("url", K.TEST_PREFIX).alias("h_test"),
                    T.hash_string("url", K.VAL_PREFIX).alias("h_val"))


@register("txt22_log10_one_plus",
          lambda: sql("SELECT doc_id, round(log10(1 + n_chars), 6) AS v FROM documents"))
def txt22(spark, sf):
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", F.round(T.log10_one_plus("n_chars"), 6).alias("v"))


def _features_sql(section):
    return P.sql_section_features(section, keep=["doc_id", "relevancia"], source="base")


@register("txt18_normalize_section2",
          lambda: sql(f"SELECT doc_id, tipo_edicao, {_sql_digest('tit_org_ementa_text', 'text')} "
                      f"FROM ({_features_sql(2)})"))
def txt18_s2(spark, sf):
    f = P.section_features(base(spark, sf), 2, keep=["doc_id", "relevancia"])
    return f.select("doc_id", "tipo_edicao", *_digest(F.col("tit_org_ementa_text"), "text"))


@register("txt18_normalize_section1",
          lambda: sql(f"SELECT doc_id, tipo_edicao, {_sql_digest('tit_org_ementa_text', 'text')} "
                      f"FROM ({_features_sql(1)})"))
def txt18_s1(spark, sf):
    f = P.section_features(base(spark, sf), 1, keep=["doc_id", "relevancia"])
    return f.select("doc_id", "tipo_edicao", *_digest(F.col("tit_org_ementa_text"), "text"))


@register("txt18_normalize_full_options",
          lambda: _sql_on_text(lambda e: T.sql_normalize_text(
              e, stopwords=K.portuguese_stopwords(), strip_accents=True, only_letters=True)))
def txt18_full(spark, sf):
    """Every normaliser step on (accents and only-letters included)."""
    return _on_text(spark, sf, lambda c: T.normalize_text(
        c, stopwords=K.portuguese_stopwords(), strip_accents=True, only_letters=True))


@register("txt24_tokens",
          lambda: sql(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) "
                      f"AS tokens_md5 FROM (SELECT doc_id, {T.sql_tokens('tit_org_ementa_text')} AS t "
                      f"FROM ({_features_sql(2)}))"))
def txt24(spark, sf):
    f = P.section_features(base(spark, sf), 2, keep=["doc_id"])
    t = T.tokens("tit_org_ementa_text")
    return f.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("txt25_ngrams",
          lambda: sql(f"SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, md5(array_to_string(g, '|')) "
                      f"AS grams_md5 FROM (SELECT doc_id, {T.sql_ngrams('t', 1, 2)} AS g FROM "
                      f"(SELECT doc_id, {T.sql_tokens('tit_org_ementa_text')} AS t "
                      f"FROM ({_features_sql(1)})))"))
def txt25(spark, sf):
    f = P.section_features(base(spark, sf), 1, keep=["doc_id"])
    g = T.ngrams(T.tokens("tit_org_ementa_text"), 1, 2)
    return f.select("doc_id", F.size(g).cast("bigint").alias("n_grams"),
                    F.md5(F.array_join(g, "|")).alias("grams_md5"))


@register("prj4_requested_columns",
          lambda: sql(P.sql_preprocess_articles(["tipo_edicao", "titulo", "secao"], keep=["doc_id"])))
def prj4(spark, sf):
    return P.preprocess_articles(articles(spark, sf), ["tipo_edicao", "titulo", "secao"],
                                 keep=["doc_id"])


@register("agg11_token_share_by_class",
          lambda: sql(f"SELECT relevancia, CAST(count(*) AS BIGINT) AS n, "
                      f"round(count_if(contains(tit_org_ementa_text, 'xxdas')) / count(*), 6) AS share "
                      f"FROM ({_features_sql(2)}) GROUP BY relevancia"))
def agg11(spark, sf):
    f = P.section_features(base(spark, sf), 2, keep=["doc_id", "relevancia"])
    return f.groupBy("relevancia").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.count_if(F.col("tit_org_ementa_text").contains("xxdas")) / F.count(F.lit(1)), 6)
        .alias("share"))


def _sql_stemmed():
    o = dict(P.SECTION2_TEXT)
    last = {k: o.pop(k) for k in ("strip_accents", "only_letters")}
    none = {"lowercase": False, "value_tokens": False, "punctuation": False, "cargo_tokens": False}
    first = T.sql_normalize_text("fulltext", stopwords=K.portuguese_stopwords(), strip_accents=False, only_letters=False, **o)
    stem = f"regexp_replace(w, '{SuffixStemmer().pattern}', '\\1')"
    words = f"list_transform(list_filter(string_split_regex({first}, '\\s+'), lambda w: w <> ''), lambda w: {stem})"
    text = T.sql_normalize_text(f"array_to_string({words}, ' ')", keep_cash=o["keep_cash"], **none, **last)
    return f"SELECT doc_id, md5({text}) AS stemmed_md5 FROM base"


@register("txt10_stemmed_text", lambda: sql(_sql_stemmed()))
def txt10(spark, sf):
    """TXT10 at its place in TXT18: a suffix stemmer after the stop words, before accents and letters."""
    out = normalize_and_stem(base(spark, sf).select("doc_id", "fulltext"), "fulltext", "stemmed", SuffixStemmer(),
                             stopwords=K.portuguese_stopwords(), **P.SECTION2_TEXT)
    return out.select("doc_id", F.md5("stemmed").alias("stemmed_md5"))
