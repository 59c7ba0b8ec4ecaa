"""Stemming at the word's place, inside the normaliser and as a stage."""

from pyspark.ml import Pipeline, PipelineModel

from gazrank.functions import text as T
from gazrank.ml.stages import TextStemmer
from gazrank.operators.stemming import SuffixStemmer, normalize_and_stem, stem_words

TEXTS = ["as casas grandes rapidamente", "casas  casas\tmas\nas", "", None, "   ", "ões às mente simplesmente", "as casas grandes rapidamente"]


def test_words_are_stemmed_in_place(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, t string").repartition(3)
    stemmer = SuffixStemmer()
    want = {i: None if t is None else " ".join(stemmer.stem(w) for w in t.split()) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.out for r in stem_words(df, "t", "out", stemmer).collect()} == want
    assert want[0] == "as casa grande rapida" and want[5] == "ões às mente simples"
    plain = {r.doc_id: r.out for r in stem_words(df, "t", "out", None).collect()}
    assert plain == {i: None if t is None else " ".join(t.split()) for i, t in enumerate(TEXTS)}
    model = Pipeline(stages=[TextStemmer(inputCol="t", outputCol="out", stemmer="gazrank.operators.stemming:SuffixStemmer")]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert {r.doc_id: r.out for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()} == want


def test_place_in_the_normaliser(spark):
    df = spark.createDataFrame([(0, "Os Ônus, certamente: R$ 500,00 das Funções!")], "doc_id long, t string")
    opts = {"lowercase": True, "value_tokens": False, "punctuation": True, "cargo_tokens": False}
    got = normalize_and_stem(df, "t", "out", SuffixStemmer(), stopwords=["os", "das"], **opts).first().out
    first = df.select(T.normalize_text("t", stopwords=["os", "das"], strip_accents=False, only_letters=False, **opts).alias("x")).first().x
    stemmed = " ".join(SuffixStemmer().stem(w) for w in first.split())
    last = spark.createDataFrame([(stemmed,)], "t string").select(T.normalize_text(
        "t", lowercase=False, value_tokens=False, punctuation=False, cargo_tokens=False).alias("x")).first().x
    assert got == last and got.startswith("onu certa")
    copies = normalize_and_stem(df, "t", "out", None, stopwords=["os", "das"], **opts).first().out
    assert copies == df.select(T.normalize_text("t", stopwords=["os", "das"], **opts).alias("x")).first().x
