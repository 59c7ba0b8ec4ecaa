"""Registered queries: features, vocabulary and similarity (VEC*, SIM*, TOP6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import preprocess as P
from ..operators import similarity as SIM
from ..operators import vectorize as V
from ..session import materialize
from .common import splits, sql
from .registry import register

TEXT = "tit_org_ementa_text"


# ----------------------------------------------------------------- shared

def features(spark, sf, section=2):
    return P.section_features(splits(spark, sf), section, keep=["doc_id", "relevancia", "split"])


def _doc_table(f, n_max: int = 1):
    """One row per document: ``(doc_id, split, relevancia, terms)``.

    The normaliser (dozens of regex passes over whole texts) is the costly
    step; its result is reduced to the distinct terms of each document and
    written once (checkpoint).  Vocabulary, train sets, validation sets and
    document counts then read this table instead of the texts.
    """
    grams = F.array_distinct(T.ngrams(T.tokens(TEXT), 1, n_max))
    return materialize(f.select("doc_id", "split", "relevancia", grams.alias("terms")))


def _explode(docs):
    return (docs.select("doc_id", "split", F.explode("terms").alias("term"))
            .withColumn("tf", F.lit(1).cast("long")))


def section2_model_terms(spark, sf, with_index=False):
    """Train vocabulary (df 2 .. 0.7) and binary terms of every split."""
    docs = _doc_table(features(spark, sf, 2))
    n_train = docs.filter(F.col("split") == "train").count()
    terms = _explode(docs)
    vocab = V.fit_vocabulary(terms.filter(F.col("split") == "train"), n_train,
                             K.SECTION2_MIN_DF, K.SECTION2_MAX_DF, with_index=with_index)
    return docs, terms, vocab


def _sql_sec2(extra=""):
    """CTEs: feat (section-2 features of splits), tok (distinct doc terms),
    ntr, voc (train vocabulary), tv (in-vocabulary doc terms), len."""
    feat = P.sql_section_features(2, keep=["doc_id", "relevancia", "split"], source="splits")
    ctes = [
        f"feat AS ({feat})",
        f"tok AS (SELECT doc_id, split, relevancia, unnest(list_distinct({T.sql_tokens(TEXT)})) AS term "
        "FROM feat)",
        "ntr AS (SELECT count(*) AS n FROM splits WHERE split = 'train')",
        "voc AS (SELECT term, count(*) AS df FROM tok WHERE split = 'train' GROUP BY term "
        "HAVING count(*) >= 2 AND count(*) <= 0.7 * (SELECT n FROM ntr))",
        "tv AS (SELECT t.* FROM tok t JOIN voc USING (term))",
        "len AS (SELECT doc_id, count(*) AS n FROM tv GROUP BY doc_id)",
    ]
    if extra:
        ctes.append(extra)
    return ", ".join(ctes)


# ----------------------------------------------------------------- VEC


@register("vec1_vocabulary",
          lambda: sql("SELECT term, CAST(df AS BIGINT) AS df, CAST(row_number() OVER (ORDER BY term) - 1 "
                      "AS BIGINT) AS idx FROM voc", _sql_sec2()))
def vec1_vocab(spark, sf):
    """AGG14 / VEC1 fit: binary unigrams, 2 <= df <= 70 % of train docs."""
    _, _, vocab = section2_model_terms(spark, sf, with_index=True)
    return vocab.select("term", F.col("df").cast("bigint").alias("df"),
                        F.col("idx").cast("bigint").alias("idx"))


@register("vec1_binary_doc_lengths",
          lambda: sql("SELECT f.doc_id, f.split, CAST(coalesce(l.n, 0) AS BIGINT) AS n_terms FROM feat f "
                      "LEFT JOIN len l USING (doc_id)", _sql_sec2()))
def vec1_docs(spark, sf):
    """VEC1 transform: in-vocabulary binary entries per document."""
    f, terms, vocab = section2_model_terms(spark, sf)
    n = V.restrict(terms, vocab).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return f.select("doc_id", "split").join(n, "doc_id", "left").select(
        "doc_id", "split", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_terms"))


def _sql_sec1_tfidf(extra=""):
    feat = P.sql_section_features(1, keep=["doc_id", "relevancia", "split"], source="splits")
    grams = T.sql_ngrams(T.sql_tokens(TEXT), 1, 2)
    ctes = [
        f"feat1 AS ({feat})",
        f"tok1 AS (SELECT doc_id, split, unnest(list_distinct({grams})) AS term FROM feat1)",
        "n1 AS (SELECT count(*) AS n FROM splits WHERE split = 'train')",
        "voc1 AS (SELECT term, ln((1 + (SELECT n FROM n1)) / (1 + count(*))) + 1 AS idf FROM tok1 "
        "WHERE split = 'train' GROUP BY term)",
        "w1 AS (SELECT t.doc_id, t.split, v.idf AS value FROM tok1 t JOIN voc1 v USING (term))",
    ]
    if extra:
        ctes.append(extra)
    return ", ".join(ctes)


def _sec1_tfidf(spark, sf):
    docs = _doc_table(features(spark, sf, 1), n_max=2)
    n_train = docs.filter(F.col("split") == "train").count()
    terms = _explode(docs)
    vocab = V.fit_vocabulary(terms.filter(F.col("split") == "train"), n_train, 1, 1.0,
                             with_index=False)
    return docs, terms, V.sklearn_idf(vocab, n_train)


@register("vec2_tfidf_doc_summary",
          lambda: sql("SELECT doc_id, split, CAST(count(*) AS BIGINT) AS n_terms, round(sum(value), 6) AS sum_w, "
                      "round(sqrt(sum(value * value)), 6) AS l2 FROM w1 GROUP BY doc_id, split",
                      _sql_sec1_tfidf()))
def vec2(spark, sf):
    """VEC2: binary TF-IDF of uni+bigrams, smooth idf + 1, no norm."""
    f, terms, vidf = _sec1_tfidf(spark, sf)
    w = V.tfidf(terms, vidf, "doc_id")
    s = w.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_terms"),
                                F.round(F.sum("value"), 6).alias("sum_w"),
                                F.round(F.sqrt(F.sum(F.col("value") ** 2)), 6).alias("l2"))
    return s.join(f.select("doc_id", "split"), "doc_id")


@register("vec3_tfidf_norm_variants",
          lambda: sql("SELECT doc_id, round(max(value) / sqrt(sum(value * value)), 6) AS max_l2_idf, "
                      "round(1.0 / count(*), 6) AS max_l1_plain FROM w1 GROUP BY doc_id",
                      _sql_sec1_tfidf()))
def vec3(spark, sf):
    """VEC3 search options: idf + l2 norm, and plain binary + l1 norm, from one pass (a row's norms are
    sums over its own entries; :func:`vectorize.tfidf` gives the normed entries themselves)."""
    _, terms, vidf = _sec1_tfidf(spark, sf)
    w = V.tfidf(terms, vidf, "doc_id")
    return w.groupBy("doc_id").agg(
        F.round(F.max("value") / F.sqrt(F.sum(F.col("value") ** 2)), 6).alias("max_l2_idf"),
        F.round(F.lit(1.0) / F.count(F.lit(1)), 6).alias("max_l1_plain"))


def _kw_sql():
    vals = ", ".join(f"({T._q(k)})" for k in K.KEYWORDS)
    anti = ", ".join(f"({T._q(k)})" for k in K.ANTI_KEYWORDS)
    norm = T.sql_normalize_text("k", stopwords=K.portuguese_stopwords(), **P.SECTION2_TEXT)
    tk = T.sql_tokens(norm)
    return (f"kw AS (SELECT DISTINCT unnest({tk}) AS term FROM (VALUES {vals}) v(k)), "
            f"akw AS (SELECT DISTINCT unnest({tk}) AS term FROM (VALUES {anti}) v(k)), "
            "keyt AS (SELECT term FROM kw WHERE term NOT IN (SELECT term FROM akw) "
            "AND term IN (SELECT term FROM voc))")


@register("vec4_keyword_weighted_counts",
          lambda: sql("SELECT tv.doc_id, CAST(count(*) AS BIGINT) AS n_terms, "
                      "CAST(count(keyt.term) AS BIGINT) AS n_key_terms, "
                      "round(sum(CASE WHEN keyt.term IS NULL THEN 1.0 ELSE 10.0 END), 6) AS weighted_sum "
                      "FROM tv LEFT JOIN keyt USING (term) GROUP BY tv.doc_id",
                      _sql_sec2(_kw_sql())))
def vec4(spark, sf):
    """VEC4: keyword terms (minus anti keywords, inside the vocabulary) x 10."""
    f, terms, vocab = section2_model_terms(spark, sf)
    norm = lambda c: T.normalize_text(c, stopwords=K.portuguese_stopwords(), **P.SECTION2_TEXT)
    keys = V.keyword_terms(spark, K.KEYWORDS, K.ANTI_KEYWORDS, vocab, norm)
    w = V.weighted_counts(V.restrict(terms, vocab), keys, 10.0)
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_terms"),
        F.count_if(F.col("value") != F.col("tf")).cast("bigint").alias("n_key_terms"),
        F.round(F.sum("value"), 6).alias("weighted_sum"))


_MC_COLS = ["titulo", "orgao", "ementa", "fulltext"]
_MC_W = [10.0, 8.0, 1.5, 1.0]


def _sql_multicol():
    pre = P.sql_preprocess_articles(["titulo"], keep=["doc_id", "orgao", "ementa", "fulltext"],
                                    source="base")
    tok = T.sql_tokens
    stacks = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS col_idx, {w} AS w, unnest(list_distinct({tok(c)})) AS term FROM pre"
        for i, (c, w) in enumerate(zip(_MC_COLS, _MC_W)))
    joined = " || ' ' || ".join(f"coalesce({c}, '')" for c in _MC_COLS)
    return (f"pre AS ({pre}), "
            f"allt AS (SELECT doc_id, unnest(list_distinct({tok('(' + joined + ')')})) AS term FROM pre), "
            "mvoc AS (SELECT DISTINCT term FROM allt), "
            f"per AS (SELECT * FROM ({stacks}) WHERE term IN (SELECT term FROM mvoc)), "
            "agg AS (SELECT doc_id, term, CASE WHEN count(*) < 4 THEN greatest(max(w), 0.0) ELSE max(w) END "
            "AS value FROM per GROUP BY doc_id, term)")


def _sql_multicol_counts():
    pre = P.sql_preprocess_articles(["titulo"], keep=["doc_id", "orgao", "ementa", "fulltext"], source="base")
    stacks = " UNION ALL ".join(f"SELECT doc_id, {w} AS w, unnest({T.sql_tokens(c)}) AS term FROM pre"
                                for c, w in zip(_MC_COLS, _MC_W))
    return f"pre AS ({pre}), per AS (SELECT doc_id, w, term, count(*) AS tf FROM ({stacks}) GROUP BY ALL)"


@register("vec5_multicolumn_max",
          lambda: sql("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(sum(value), 6) AS sum_v, "
                      "round(max(value), 6) AS max_v FROM agg WHERE value <> 0 GROUP BY doc_id",
                      _sql_multicol()))
def vec5(spark, sf):
    """VEC5: one vocabulary over four columns, each weighted, combined by max."""
    from .common import base
    pre = P.preprocess_articles(base(spark, sf), ["titulo"],
                                keep=["doc_id", "orgao", "ementa", "fulltext"])
    _, vals = V.multicolumn_counts(pre, "doc_id", _MC_COLS, _MC_W, agg="max")
    return vals.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_terms"),
                                      F.round(F.sum("value"), 6).alias("sum_v"),
                                      F.round(F.max("value"), 6).alias("max_v"))


@register("vec5_multicolumn_sum",
          lambda: sql("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, round(sum(value), 6) AS sum_v, round(max(value), 6) AS max_v "
                      "FROM (SELECT doc_id, term, sum(w * tf) AS value FROM per GROUP BY doc_id, term) WHERE value <> 0 GROUP BY doc_id",
                      _sql_multicol_counts()))
def vec5_sum(spark, sf):
    """VEC5: counts of four columns, weighted and added, by the pipeline stage."""
    from ..ml.vectorizers import WeightedCounts
    from .common import base
    pre = P.preprocess_articles(base(spark, sf), ["titulo"], keep=["doc_id", "orgao", "ementa", "fulltext"])
    stage = WeightedCounts(inputCols=_MC_COLS, outputCol="features", weights=_MC_W, agg="sum", binary=False)
    # the entries that the sparse vector holds; as an array it would be as long as the vocabulary, in every row
    values = F.filter(F.unwrap_udt("features")["values"], lambda v: v != 0)
    out = stage.fit(pre).transform(pre).select("doc_id", values.alias("v"))
    return out.filter(F.size("v") > 0).select(
        "doc_id", F.size("v").cast("bigint").alias("n_terms"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("sum_v"),
        F.round(F.array_max("v"), 6).alias("max_v"))


@register("vec6_sparse_max",
          lambda: sql(
              "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_entries, round(sum(v), 6) AS sum_v FROM ("
              "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, greatest(coalesce(a.v, 0.0), coalesce(b.v, 0.0)) AS v "
              "FROM (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS v FROM (SELECT doc_id, "
              f"unnest({T.sql_tokens('lower(ementa)')}) AS term FROM base) GROUP BY doc_id, term) a "
              "FULL OUTER JOIN (SELECT doc_id, term, -1.0 * count(*) AS v FROM (SELECT doc_id, "
              f"unnest({T.sql_tokens('lower(fulltext)')}) AS term FROM base) GROUP BY doc_id, term) b "
              "ON a.doc_id = b.doc_id AND a.term = b.term) WHERE v <> 0 GROUP BY doc_id"))
def vec6(spark, sf):
    """VEC6: element-wise max of ementa counts and minus full-text counts."""
    from .common import base
    b = base(spark, sf).select("doc_id", F.lower("ementa").alias("e"), F.lower("fulltext").alias("t"))
    a = V.doc_terms(b, "doc_id", "e", binary=False).select(
        "doc_id", "term", F.col("tf").cast("double").alias("value"))
    c = V.doc_terms(b, "doc_id", "t", binary=False).select(
        "doc_id", "term", (-F.col("tf").cast("double")).alias("value"))
    m = V.sparse_max(a, c, ["doc_id", "term"])
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_entries"),
                                   F.round(F.sum("value"), 6).alias("sum_v"))


@register("vec7_onehot_edition",
          lambda: sql(f"SELECT doc_id, CASE WHEN {T.sql_edition_type('edicao')} = 'Ordinária' THEN 1.0 "
                      "ELSE 0.0 END AS tipo_edicao_ordinaria FROM base"))
def vec7(spark, sf):
    """VEC7: one-hot of the edition type, first category dropped."""
    from ..ml.models import edition_indicator
    from .common import base
    df = base(spark, sf).select("doc_id", T.edition_type("edicao").alias("tipo_edicao"))
    return edition_indicator(output_col="tipo_edicao_ordinaria").transform(df).select("doc_id", "tipo_edicao_ordinaria")


@register("agg13_term_in_every_doc",
          lambda: sql("SELECT CAST((SELECT n FROM ntr) AS BIGINT) AS n_docs, CAST(max(df) AS BIGINT) AS max_df, "
                      "max(df) >= (SELECT n FROM ntr) AS any_in_all FROM (SELECT term, count(*) AS df FROM tok "
                      "WHERE split = 'train' GROUP BY term)", _sql_sec2()))
def agg13(spark, sf):
    docs, terms, _ = section2_model_terms(spark, sf)
    n = docs.filter(F.col("split") == "train").count()
    return V.term_in_every_doc(terms.filter(F.col("split") == "train"), n)


# ----------------------------------------------------------------- SIM


def val_train_sets(spark, sf):
    docs, terms, vocab = section2_model_terms(spark, sf)
    ranks = SIM.term_ranks(vocab)
    tr = terms.filter(F.col("split") == "train")
    va = terms.filter(F.col("split") == "val")
    return docs, SIM.term_sets(va, "doc_id", ranks), SIM.term_sets(tr, "doc_id", ranks)


_SQL_PAIRS = ("pairs AS (SELECT a.doc_id AS val_id, b.doc_id AS train_id, count(*) AS ov FROM tv a "
              "JOIN tv b ON a.term = b.term WHERE a.split = 'val' AND b.split = 'train' GROUP BY 1, 2), "
              "sims AS (SELECT val_id, train_id, ov / sqrt(la.n * lb.n) AS sim FROM pairs "
              "JOIN len la ON la.doc_id = val_id JOIN len lb ON lb.doc_id = train_id)")


def nearest_train_articles(spark, sf, k=10, threshold=K.SIM_THRESHOLD):
    f, va, tr = val_train_sets(spark, sf)
    top = SIM.top_k_similar(va.withColumnRenamed("doc_id", "val_id"),
                            tr.withColumnRenamed("doc_id", "train_id"),
                            "val_id", "train_id", k, threshold)
    lab = f.select("doc_id", "relevancia")
    return (top.join(lab.withColumnRenamed("doc_id", "train_id")
                     .withColumnRenamed("relevancia", "train_relevancia"), "train_id")
            .join(lab.withColumnRenamed("doc_id", "val_id")
                  .withColumnRenamed("relevancia", "val_relevancia"), "val_id")
            .select("val_id", "train_id", F.col("rank").cast("int").alias("rank"),
                    F.round("sim", 6).alias("sim"), "train_relevancia", "val_relevancia"))


@register("sim3_nearest_train_articles",
          lambda: sql(
              "SELECT val_id, train_id, CAST(rnk AS INT) AS rank, round(sim, 6) AS sim, "
              "b.relevancia AS train_relevancia, a.relevancia AS val_relevancia FROM ("
              "SELECT *, row_number() OVER (PARTITION BY val_id ORDER BY sim DESC, train_id) AS rnk "
              "FROM sims WHERE sim > 0.3) s JOIN splits a ON a.doc_id = s.val_id "
              "JOIN splits b ON b.doc_id = s.train_id WHERE rnk <= 10",
              _sql_sec2(_SQL_PAIRS)))
def sim3(spark, sf):
    """Flagship (TOP6 + SIM3 + JN5): for each validation article its ten most
    similar training articles (binary cosine > 0.30) with their labels."""
    return nearest_train_articles(spark, sf)


@register("sim3_match_urls",
          lambda: sql("SELECT val_id, train_id, CAST(rnk AS INT) AS rank, round(sim, 6) AS sim, b.url AS train_url FROM ("
                      "SELECT *, row_number() OVER (PARTITION BY val_id ORDER BY sim DESC, train_id) AS rnk "
                      "FROM sims WHERE sim > 0.3) s JOIN splits b ON b.doc_id = s.train_id WHERE rnk <= 10",
                      _sql_sec2(_SQL_PAIRS)))
def sim3_urls(spark, sf):
    """SIM3 audit as it is read: each match with its url."""
    top = nearest_train_articles(spark, sf).select("val_id", "train_id", "rank", "sim")
    urls = splits(spark, sf).select(F.col("doc_id").alias("train_id"), F.col("url").alias("train_url"))
    return top.join(urls, "train_id")


_SQL_SELF = ("pairs AS (SELECT a.doc_id AS doc_id, b.doc_id AS other_id, count(*) AS ov FROM tv a "
             "JOIN tv b ON a.term = b.term WHERE a.split = 'train' AND b.split = 'train' AND a.doc_id <> b.doc_id GROUP BY 1, 2), "
             "sims AS (SELECT doc_id, other_id, ov / sqrt(la.n * lb.n) AS sim FROM pairs "
             "JOIN len la USING (doc_id) JOIN len lb ON lb.doc_id = other_id)")


@register("sim3_train_audit",
          lambda: sql("SELECT doc_id, other_id, CAST(rnk AS INT) AS rank, round(sim, 6) AS sim FROM ("
                      "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, other_id) AS rnk "
                      "FROM sims WHERE sim > 0.3) WHERE rnk <= 10", _sql_sec2(_SQL_SELF)))
def sim3_train_audit(spark, sf):
    """SIM3 within the training split: each article's ten most similar others."""
    _, _, tr = val_train_sets(spark, sf)
    top = SIM.top_k_similar(tr, tr.withColumnRenamed("doc_id", "other_id"), "doc_id", "other_id", 10,
                            K.SIM_THRESHOLD, same_collection=True)
    return top.select("doc_id", "other_id", F.col("rank").cast("int").alias("rank"), F.round("sim", 6).alias("sim"))


@register("sim3_match_class_histogram",
          lambda: sql("SELECT val_id, s.relevancia, CAST(count(*) AS BIGINT) AS n_matches FROM "
                      "(SELECT val_id, train_id, relevancia FROM sims JOIN splits ON doc_id = train_id "
                      "WHERE sim > 0.3) s GROUP BY val_id, s.relevancia",
                      _sql_sec2(_SQL_PAIRS)))
def sim3_hist(spark, sf):
    """SIM3 histogram: classes of all train matches above the threshold."""
    f, va, tr = val_train_sets(spark, sf)
    return SIM.match_class_counts(
        va.withColumnRenamed("doc_id", "val_id"), tr.withColumnRenamed("doc_id", "train_id"),
        f.select(F.col("doc_id").alias("train_id"), "relevancia"),
        "val_id", "train_id", "relevancia", K.SIM_THRESHOLD)


@register("sim2_pair_summary",
          lambda: sql("SELECT CAST(count(*) AS BIGINT) AS n_pairs, round(avg(sim), 6) AS mean_sim, "
                      "CAST(count(DISTINCT val_id) AS BIGINT) AS n_val_docs FROM sims WHERE sim >= 0.3",
                      _sql_sec2(_SQL_PAIRS)))
def sim2(spark, sf):
    """SIM2 train x validation similarity, summarised from set-level pairs
    (pairs are counted through multiplicities, never expanded)."""
    _, va, tr = val_train_sets(spark, sf)
    tm, tu = SIM.collapse(va, "doc_id")
    _, ru = SIM.collapse(tr, "doc_id")
    pairs = SIM.set_pairs(ru, tu, K.SIM_THRESHOLD)
    lm = ru.select(F.col("skey").alias("lkey"), F.col("mult").alias("lm"))
    rm = tu.select(F.col("skey").alias("rkey"), F.col("mult").alias("rm"))
    j = pairs.join(lm, "lkey").join(rm, "rkey")
    per = j.groupBy("rkey", "rm").agg(F.sum("lm").alias("sl"), F.sum(F.col("lm") * F.col("sim")).alias("sls"))
    return per.agg(F.sum(F.col("sl") * F.col("rm")).cast("bigint").alias("n_pairs"),
                   F.round(F.sum(F.col("sls") * F.col("rm")) / F.sum(F.col("sl") * F.col("rm")), 6)
                   .alias("mean_sim"),
                   F.sum("rm").cast("bigint").alias("n_val_docs"))


# The weighted form reads section 1's vectors: TF-IDF of uni- and bigrams, in which a pair's dot product is several units.
WEIGHTED_THRESHOLD = 1.0


def weighted_val_train(spark, sf):
    """Weighted vectors (train idf, binary tf, uni- and bigrams of the section-1 text) of validation and train."""
    docs = _doc_table(features(spark, sf, 1), 2)
    terms = _explode(docs)
    train = terms.filter(F.col("split") == "train")
    n_train = docs.filter(F.col("split") == "train").count()
    vocab = V.sklearn_idf(V.fit_vocabulary(train, n_train, with_index=False), n_train)
    ranks = materialize(SIM.term_ranks(vocab))
    values = V.tfidf(terms, vocab, "doc_id")
    vectors = lambda name: SIM.weighted_vectors(
        values.join(docs.filter(F.col("split") == name).select("doc_id"), "doc_id", "left_semi"), "doc_id", ranks)
    return vectors("val"), vectors("train")


def _sql_weighted():
    feat = P.sql_section_features(1, keep=["doc_id", "relevancia", "split"], source="splits")
    grams = T.sql_ngrams(T.sql_tokens(TEXT), 1, 2)
    return (f"wf AS ({feat}), "
            f"wt AS (SELECT doc_id, split, unnest(list_distinct({grams})) AS term FROM wf), "
            "wn AS (SELECT count(*) AS n FROM splits WHERE split = 'train'), "
            "wv AS (SELECT term, ln((1.0 + (SELECT n FROM wn)) / (1.0 + count(*))) + 1.0 AS w FROM wt WHERE split = 'train' "
            "GROUP BY term), "
            "we AS (SELECT doc_id, split, wt.term, w FROM wt JOIN wv ON wt.term = wv.term), "
            "wd AS (SELECT doc_id, split, sum(w) AS s, md5(string_agg(term, '|' ORDER BY term)) AS k FROM we GROUP BY 1, 2), "
            "wr AS (SELECT split, k, min(doc_id) AS rep, count(*) AS n FROM wd GROUP BY 1, 2), "
            "ws AS (SELECT we.split, rep, n, term, w, s FROM we JOIN wd USING (doc_id) JOIN wr ON wr.k = wd.k "
            "AND wr.split = wd.split AND wr.rep = we.doc_id), "
            "wp AS (SELECT a.rep AS train_rep, b.rep AS val_rep, any_value(a.n) AS train_copies, any_value(b.n) AS val_copies, "
            "sum(a.w * b.w) / sqrt(any_value(a.s) * any_value(b.s)) AS sim FROM ws a JOIN ws b ON a.term = b.term "
            "WHERE a.split = 'train' AND b.split = 'val' GROUP BY 1, 2)")


@register("sim2_weighted_pairs",
          lambda: sql("SELECT train_rep, val_rep, CAST(train_copies AS BIGINT) AS train_copies, CAST(val_copies AS BIGINT) AS "
                      f"val_copies, round(sim, 6) AS sim FROM wp WHERE sim >= {WEIGHTED_THRESHOLD}", _sql_weighted()))
def sim2_weighted(spark, sf):
    """SIM2, section 1's form: dot product over the root of both sums of weights. One row for each pair of different
    vectors (a vector's first document, and how many documents have it)."""
    val, train = weighted_val_train(spark, sf)
    return SIM.weighted_pairs(train, val, WEIGHTED_THRESHOLD).select(
        F.col("left_rep").alias("train_rep"), F.col("right_rep").alias("val_rep"), F.col("left_copies").alias("train_copies"),
        F.col("right_copies").alias("val_copies"), F.round("sim", 6).alias("sim"))


@register("sim1_term_table",
          lambda: sql("SELECT term, CAST(count(*) AS BIGINT) AS df, round(count(*) / (SELECT n FROM cn), 9) AS mean FROM ctv GROUP BY term",
                      _sql_sim1()))
def sim1_terms(spark, sf):
    """SIM1: vocabulary of the labelled corpus with its mean vector (each term's share of the documents)."""
    docs = _doc_table(features(spark, sf, 2))
    n = docs.count()
    vocab = V.fit_vocabulary(_explode(docs), n, K.SECTION2_MIN_DF, K.SECTION2_MAX_DF, with_index=False)
    return vocab.select("term", "df", F.round(F.col("df") / n, 9).alias("mean"))


def _sql_sim1():
    feat = P.sql_section_features(2, keep=["doc_id"], source="base")
    return (f"cf AS ({feat}), "
            f"ct AS (SELECT doc_id, unnest(list_distinct({T.sql_tokens(TEXT)})) AS term FROM cf), "
            "cn AS (SELECT count(*) AS n FROM base), "
            "cv AS (SELECT term FROM ct GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.7 * (SELECT n FROM cn)), "
            "ctv AS (SELECT ct.* FROM ct JOIN cv USING (term)), "
            "cl AS (SELECT doc_id, count(*) AS n FROM ctv GROUP BY doc_id), "
            "cp AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, count(*) / sqrt(any_value(la.n) * any_value(lb.n)) "
            "AS sim FROM ctv a JOIN ctv b ON a.term = b.term AND a.doc_id <> b.doc_id "
            "JOIN cl la ON la.doc_id = a.doc_id JOIN cl lb ON lb.doc_id = b.doc_id GROUP BY 1, 2)")


@register("sim1_neighbour_stats",
          lambda: sql("SELECT cl.doc_id, CAST(count(cp.b_id) AS BIGINT) AS n_neighbours, round(max(cp.sim), 6) "
                      "AS max_sim FROM cl LEFT JOIN cp ON cp.a_id = cl.doc_id AND cp.sim > 0.3 "
                      "GROUP BY cl.doc_id", _sql_sim1()))
def sim1(spark, sf):
    """SIM1: self-similarity of the labelled corpus (vocabulary fitted on it):
    number of other documents above 0.30 and the best similarity."""
    docs = _doc_table(features(spark, sf, 2))
    n = docs.count()
    terms = _explode(docs)
    vocab = V.fit_vocabulary(terms, n, K.SECTION2_MIN_DF, K.SECTION2_MAX_DF)
    sets = SIM.term_sets(terms, "doc_id", SIM.term_ranks(vocab))
    st = SIM.neighbour_stats(sets, "doc_id", K.SIM_THRESHOLD)
    return st.select("doc_id", "n_neighbours", F.round("max_sim", 6).alias("max_sim"))
