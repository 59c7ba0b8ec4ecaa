"""Golden strings (FIXTURES.md section 5) through the Spark expressions."""

from pyspark.sql import functions as F

from gazrank import constants as K
from gazrank.functions import text as T


def _one(spark, expr_fn, value):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr_fn(F.col("s")).alias("o")).first()["o"]


def test_article_type(spark):
    cases = {
        "PORTARIA Nº 12, DE 7 DE JULHO DE 2020": "portaria",
        "Resolução-RE nº 1.234/2020": "resolução-re",
        "AVISO DE LICITAÇÃOPREGÃO ELETRÔNICO | Lote 2": "aviso de licitação pregão eletrônico lote 2",
        "MEDIDA PROVISÓRIA Nº 9, de 1º de março de 2021": "medida provisória",
        None: "",
    }
    for src, want in cases.items():
        assert _one(spark, T.article_type, src) == want


def test_punctuation_and_letters(spark):
    assert _one(spark, T.remove_punctuation, "a/b-c$ (x) 'q\" R$ 1.000,00") == "a bc$ x q R$ 100000"
    assert _one(spark, T.keep_only_letters, "linha1\nlinha2 R$ 3") == "linhalinha R$"


def test_num_to_scale(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1250.0,), (10643543.05,)], "x double")
    got = [r[0] for r in df.select(T.num_to_scale("x")).collect()]
    assert got == [0, 0, 10, 23]


def test_value_tokens(spark):
    got = _one(spark, T.values_to_token, "R$ 10.643.543,05 (dez) 0,50 R$0 1 reais")
    assert got == "R$  xx" + "v" * 23 + "xx  (dez)  xxxx  R$ xxxx   xxxx  reais"
    got = _one(spark, T.values_to_token, "R$ 1.000.000 reais 99,99%9,99")
    assert got == "R$  xx" + "v" * 20 + "xx  reais 99,99% xxvvvxx "


def test_cargo_tokens(spark):
    assert _one(spark, T.tokenize_cargos, "Exonerar DAS-102.4") == "Exonerar  xxdasquatroxx "
    csp = [(p, t) for p, t in K.CARGO_PATTERNS if "csp" in p]
    assert _one(spark, lambda c: T.tokenize_cargos(c, csp), "(CSP) csp csp") == " xxcspxx  xxcspxx csp"
    cne = [(p, t) for p, t in K.CARGO_PATTERNS if "cne" in p]
    assert _one(spark, lambda c: T.tokenize_cargos(c, cne), "CNE-07") == " xxcne07xx "
    assert _one(spark, T.tokenize_cargos, "ácsp ") == "ácsp "


POSTS = [
    ("x DAS 101.6 y", "x  xxdasseisxx  y"), ("DAS-102.5", " xxdascincoxx "), ("das 103.4", " xxdasquatroxx "),
    ("das101.3", " xxdastresxx "), ("DAS--101.2", " xxdasdoisxx "), ("das 101.1", " xxdasumxx "),
    ("a CA I b", "a xxcaixx b"), ("a CA-II b", "a xxcaiixx b"), ("CA-APO 1", " xxcaapoumxx "), ("ca-apo-2", " xxcaapodoisxx "),
    ("a CDT b", "a xxcdtxx b"), ("CCD I b", " xxccdixx b"), ("CCD-II b", " xxccdiixx b"), ("CGE I b", " xxcgeixx b"),
    ("CGE II b", " xxcgeiixx b"), ("CGE-III b", " xxcgeiiixx b"), ("CGE IV b", " xxcgeivxx b"), ("CGE V b", " xxcgevxx b"),
    ("CPAGLO", " xxcpagloxx "), ("a CSP b", "a xxcspxx b"), ("a CSU b", "a xxcsuxx b"), ("a CD-1 b", "a xxcdumxx b"),
    ("a CD.2 b", "a xxcddoisxx b"), ("a NE b", "a xxnexx b"), ("CETG IV b", " xxcetgivxx b"), ("CETG-V b", " xxcetgvxx b"),
    ("CETG VI b", " xxcetgvixx b"), ("CETG VII b", " xxcetgviixx b"), ("a FDS 1 b", "a xxfdsumxx b"),
    ("FCPE 101.5", " xxfcpecincoxx "), ("FPE 101.4", " xxfcpequatroxx "), ("fcpe-102.3", " xxfcpetresxx "),
    ("FCPE101.2", " xxfcpedoisxx "), ("FCPE 101.1", " xxfcpeumxx "), ("Natureza Especial", " xxnaturezaespecialxx "),
    ("CNE 07", " xxcne07xx "),
]


def test_every_post_pattern(spark):
    """Each pattern alone on a post of its kind, written out by hand."""
    assert len(POSTS) == len(K.CARGO_PATTERNS) == 36
    for (src, want), pattern in zip(POSTS, K.CARGO_PATTERNS, strict=True):
        assert _one(spark, lambda c, p=pattern: T.tokenize_cargos(c, [p]), src) == want, pattern


def test_adjacent_mentions_share_their_separator(spark):
    ne = [p for p in K.CARGO_PATTERNS if p[1] == " xxnexx "]
    assert _one(spark, lambda c: T.tokenize_cargos(c, ne), "a NE NE b") == "a xxnexx NE b"


def test_each_money_pattern(spark):
    for src, want in (("R$ 10,00 x", "R$  xxv"), ("10,00 reais x", " xxv"), ("10,00 x", " xxv")):
        assert _one(spark, T.values_to_token, src).startswith(want)


def test_certified_and_hash(spark):
    assert _one(spark, T.clean_certified, "Versão certificada Diário Página: 12 Órgão: Texto") == "Texto"
    url = "http://www.in.gov.br/web/dou/-/doc-1"
    assert _one(spark, lambda c: T.hash_string(c, K.TEST_PREFIX), url) == 4071681641
    assert _one(spark, lambda c: T.hash_string(c, K.VAL_PREFIX), url) == 1887151717


def test_tokens(spark):
    assert _one(spark, T.tokens, "x²y") == ["x²y"]
    assert _one(spark, T.tokens, "½ab") == ["½ab"]
    assert _one(spark, T.tokens, "éa") == []


def test_stopwords_list():
    sw = K.portuguese_stopwords()
    assert len(sw) == 204 and "é" in sw and "de" in sw


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "t array<string>")
    got = [r[0] for r in df.select(T.ngrams(F.col("t"), 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], [], ["x"]]
