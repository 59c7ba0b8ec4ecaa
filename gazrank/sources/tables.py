"""Driver tables and the article adapter.

The test tables are generic (``documents``, ``labels``); the adapter turns
them into the gazette-article schema the operators work on.  The same
adapter exists as SQL text (:data:`ARTICLES_SQL`) so the DuckDB oracle sees
identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("relevancia", T.IntegerType()),
    T.StructField("identifica", T.StringType()),
    T.StructField("secao", T.IntegerType()),
    T.StructField("edicao", T.StringType()),
    T.StructField("pagina", T.StringType()),
    T.StructField("data_pub", T.StringType()),
    T.StructField("orgao", T.StringType()),
    T.StructField("ementa", T.StringType()),
    T.StructField("resumo", T.StringType()),
    T.StructField("fulltext", T.StringType()),
    T.StructField("assina", T.StringType()),
    T.StructField("cargo", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("url_certificado", T.StringType()),
    T.StructField("data_registro", T.StringType()),
])
ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key: Column, cases: list[tuple[int, Column | str | None]],
          default: Column | str | None) -> Column:
    expr = None
    for value, out in cases:
        out_c = out if isinstance(out, Column) else F.lit(out)
        expr = F.when(key == value, out_c) if expr is None else expr.when(key == value, out_c)
    dflt = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(dflt)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article table (``doc_id`` + ``ARTICLE_SCHEMA``) built from the
    ``documents`` and ``labels`` tables."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return articles_from(d, lab)


def articles_from(documents: DataFrame, labels: DataFrame) -> DataFrame:
    d = documents.alias("d")
    lab = labels.select(F.col("doc_id").alias("l_doc_id"), F.col("toxic").alias("l_toxic"))
    j = d.join(lab, F.col("doc_id") == F.col("l_doc_id"), "left")
    i = F.col("doc_id")
    s = lambda x: x.cast("string")
    relevancia = (F.when(F.col("l_doc_id").isNull(), F.lit(None).cast("int"))
                  .when(F.col("l_toxic") == 1, F.lit(1))
                  .otherwise((F.lit(1) + i % 5).cast("int")))
    identifica = _case(i % 7, [
        (0, F.concat(F.lit("PORTARIA Nº "), s(i), F.lit(", DE 7 DE JULHO DE 2020"))),
        (1, F.concat(F.lit("DECRETO Nº 10."), s(i % 900 + 100))),
        (2, "Resolução-RE nº 1.234/2020"),
        (3, "MEDIDA PROVISÓRIA Nº 9, de 1º de março de 2021"),
        (4, "AVISO DE LICITAÇÃOPREGÃO ELETRÔNICO | Lote 2"),
        (5, "LEI Nº 13.999"),
    ], None)
    secao = (F.lit(1) + F.floor(i / 7).cast("bigint") % 3).cast("int")
    edicao = F.when(i % 11 == 0, F.concat(s(i % 250), F.lit("-A"))).otherwise(s(i % 250))
    data_pub = s(F.date_add(F.lit("2020-01-01").cast("date"), (i % 600).cast("int")))
    orgao = _case(i % 13, [
        (0, "Ministério da Educação/Universidade Federal"),
        (1, "Poder Judiciário/Tribunal"),
        (2, "Ministério da Economia/Secretaria Especial/Superintendência Regional"),
        (3, "Ministério da Defesa/Comando Militar do Sul"),
        (4, "Ministério do Turismo/Secretaria de Fomento e Incentivo à Cultura"),
        (5, "Ineditoriais"),
        (6, "Poder Legislativo"),
        (7, None),
        (8, "Presidência da República"),
    ], "Ministério da Saúde/Gabinete do Ministro")
    ementa = F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Dispõe sobre "), F.col("source"), F.lit(" "), F.col("lang")))
    tail = _case(i % 5, [
        (0, "Conceder aposentadoria, R$ 0,50."),
        (1, "Nomear cargo (CSP) código DAS 101.2; 7,55% de 3,10 reais"),
        (2, "Exonerar DAS-102.4 e CNE-07, valor R$ 1.250,00"),
        (3, "Designar FCPE 101.3 no conselho, 2.000 reais"),
    ], "Natureza Especial DAS 101.6 R$ 10.643.543,05 Este conteúdo não substitui o publicado na versão certificada.")
    head = F.when(i % 10 == 0, F.lit("Versão certificada Diário Página: 12 Órgão: ")).otherwise(F.lit(""))
    fulltext = F.when(i % 97 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(head, F.col("text"), F.lit(" "), tail))
    url = F.when(i % 41 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("http://www.in.gov.br/web/dou/-/doc-"), s(i)))
    null_s = F.lit(None).cast("string")
    return j.select(
        i.alias("doc_id"),
        relevancia.alias("relevancia"),
        identifica.alias("identifica"),
        secao.alias("secao"),
        edicao.alias("edicao"),
        s(i % 100).alias("pagina"),
        data_pub.alias("data_pub"),
        orgao.alias("orgao"),
        ementa.alias("ementa"),
        null_s.alias("resumo"),
        fulltext.alias("fulltext"),
        null_s.alias("assina"),
        null_s.alias("cargo"),
        url.alias("url"),
        null_s.alias("url_certificado"),
        F.lit("2022-01-01").alias("data_registro"),
    )


def classified(arts: DataFrame) -> DataFrame:
    """Labelled articles."""
    return arts.filter(F.col("relevancia").isNotNull())


def curated(arts: DataFrame) -> DataFrame:
    """Second, curated source: all top relevance, no ``data_registro``."""
    return (arts.filter(F.col("doc_id") % 5 == 4)
            .withColumn("relevancia", F.lit(5))
            .drop("data_registro"))


def pool(arts: DataFrame) -> DataFrame:
    """Unlabelled pool."""
    return arts.filter(F.col("relevancia").isNull())


# Same adapter as SQL text, for the DuckDB oracle (and for Spark SQL users).
ARTICLES_SQL = """SELECT d.doc_id AS doc_id,
 CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 1 ELSE CAST(1 + d.doc_id % 5 AS INT) END AS relevancia,
 CASE d.doc_id % 7 WHEN 0 THEN 'PORTARIA Nº ' || CAST(d.doc_id AS STRING) || ', DE 7 DE JULHO DE 2020' WHEN 1 THEN 'DECRETO Nº 10.' || CAST(d.doc_id % 900 + 100 AS STRING) WHEN 2 THEN 'Resolução-RE nº 1.234/2020' WHEN 3 THEN 'MEDIDA PROVISÓRIA Nº 9, de 1º de março de 2021' WHEN 4 THEN 'AVISO DE LICITAÇÃOPREGÃO ELETRÔNICO | Lote 2' WHEN 5 THEN 'LEI Nº 13.999' ELSE NULL END AS identifica,
 CAST(1 + CAST(floor(d.doc_id / 7) AS BIGINT) % 3 AS INT) AS secao,
 CASE WHEN d.doc_id % 11 = 0 THEN CAST(d.doc_id % 250 AS STRING) || '-A' ELSE CAST(d.doc_id % 250 AS STRING) END AS edicao,
 CAST(d.doc_id % 100 AS STRING) AS pagina,
 CAST(DATE '2020-01-01' + CAST(d.doc_id % 600 AS INT) AS STRING) AS data_pub,
 CASE d.doc_id % 13 WHEN 0 THEN 'Ministério da Educação/Universidade Federal' WHEN 1 THEN 'Poder Judiciário/Tribunal' WHEN 2 THEN 'Ministério da Economia/Secretaria Especial/Superintendência Regional' WHEN 3 THEN 'Ministério da Defesa/Comando Militar do Sul' WHEN 4 THEN 'Ministério do Turismo/Secretaria de Fomento e Incentivo à Cultura' WHEN 5 THEN 'Ineditoriais' WHEN 6 THEN 'Poder Legislativo' WHEN 7 THEN NULL WHEN 8 THEN 'Presidência da República' ELSE 'Ministério da Saúde/Gabinete do Ministro' END AS orgao,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'Dispõe sobre ' || d.source || ' ' || d.lang END AS ementa,
 CAST(NULL AS STRING) AS resumo,
 CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE
  CASE WHEN d.doc_id % 10 = 0 THEN 'Versão certificada Diário Página: 12 Órgão: ' ELSE '' END || d.text || ' ' ||
  CASE d.doc_id % 5 WHEN 0 THEN 'Conceder aposentadoria, R$ 0,50.' WHEN 1 THEN 'Nomear cargo (CSP) código DAS 101.2; 7,55% de 3,10 reais' WHEN 2 THEN 'Exonerar DAS-102.4 e CNE-07, valor R$ 1.250,00' WHEN 3 THEN 'Designar FCPE 101.3 no conselho, 2.000 reais' ELSE 'Natureza Especial DAS 101.6 R$ 10.643.543,05 Este conteúdo não substitui o publicado na versão certificada.' END END AS fulltext,
 CAST(NULL AS STRING) AS assina, CAST(NULL AS STRING) AS cargo,
 CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE 'http://www.in.gov.br/web/dou/-/doc-' || CAST(d.doc_id AS STRING) END AS url,
 CAST(NULL AS STRING) AS url_certificado,
 CAST(DATE '2022-01-01' AS STRING) AS data_registro
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
