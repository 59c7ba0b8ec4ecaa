"""Article preprocessing (TXT5-TXT7, TXT18 configurations).

``preprocess_articles`` derives the requested columns on the same row (no
join: the hierarchy split and the joined texts are ``withColumns``), and
``normalize_columns`` applies the text normaliser.  Both are narrow
transformations: no shuffle, one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T

DERIVED = {"titulo", "tipo_edicao", "ementa_text", "tit_ementa_text", "tit_org_ementa_text",
           "org_ementa_text", "orgaos"}


def max_levels(df: DataFrame, col: str = "orgao", fillna: str | None = None) -> int:
    """AGG12 fitted once: deepest hierarchy in the data (a one-row aggregate)."""
    c = F.col(col) if fillna is None else F.coalesce(F.col(col), F.lit(fillna))
    row = df.agg(F.max(T.count_levels(c)).alias("n")).first()
    return int(row["n"] or 1)


def preprocess_articles(df: DataFrame, columns: list[str], fillna: str | None = None,
                        keep: list[str] | None = None, n_levels: int | None = None,
                        prefix: str = "org") -> DataFrame:
    """TXT7: derive ``columns`` and keep them (plus ``keep``, e.g. the id).

    * ``titulo``: article type of the title; null title gives ''.
    * ``tipo_edicao``: 'Extra' / 'Ordinária'.
    * ``secao`` as text.
    * ``fillna``: string columns are filled with the token *after* the title,
      edition and section are derived, *before* texts are joined; joined
      texts recompute the title from the filled title, so they carry the
      token.
    * ``orgaos``: ``org1..orgN``, N fitted by :func:`max_levels` unless given.
    """
    keep = list(keep or [])
    out = df
    if "titulo" in columns:
        out = out.withColumn("titulo", T.article_type("identifica"))
    if "tipo_edicao" in columns:
        out = out.withColumn("tipo_edicao", T.edition_type("edicao"))
    if "secao" in columns:
        out = out.withColumn("secao", F.col("secao").cast("string"))
    if fillna is not None:
        str_cols = [f.name for f in out.schema.fields
                    if f.dataType.simpleString() == "string"]
        out = out.na.fill(fillna, subset=str_cols)
    org_text = F.replace(F.col("orgao"), F.lit("/"), F.lit(" "))
    sp = F.lit(" ")
    if "ementa_text" in columns:
        out = out.withColumn("ementa_text", F.concat(F.col("ementa"), sp, F.col("fulltext")))
    if "tit_ementa_text" in columns or "tit_org_ementa_text" in columns:
        out = out.withColumn("titulo", T.article_type("identifica"))
    if "tit_ementa_text" in columns:
        out = out.withColumn("tit_ementa_text", F.concat(F.col("titulo"), sp, F.col("ementa"), sp,
                                                         F.col("fulltext")))
    if "tit_org_ementa_text" in columns:
        out = out.withColumn("tit_org_ementa_text",
                             F.concat(F.col("titulo"), sp, org_text, sp, F.col("ementa"), sp,
                                      F.col("fulltext")))
    if "org_ementa_text" in columns:
        out = out.withColumn("org_ementa_text",
                             F.concat(org_text, sp, F.col("ementa"), sp, F.col("fulltext")))
    cols = [c for c in columns if c != "orgaos"]
    if "orgaos" in columns:
        n = n_levels or max_levels(out, "orgao")
        lv = []
        for i in range(1, n + 1):
            c = T.level("orgao", i)
            if fillna is not None:
                c = F.coalesce(c, F.lit(fillna))
            lv.append(c.alias(f"{prefix}{i}"))
        out = out.select("*", *lv)
        cols += [f"{prefix}{i}" for i in range(1, n + 1)]
    return out.select(*[c for c in keep if c not in cols], *cols)


def sql_preprocess_articles(columns: list[str], fillna: str | None = None,
                            keep: list[str] | None = None, source: str = "articles",
                            n_levels: int | None = None, prefix: str = "org") -> str:
    """SQL text of :func:`preprocess_articles` (string columns of the
    article schema are the ones filled)."""
    from ..sources.tables import ARTICLE_SCHEMA

    def f(col: str) -> str:
        return col if fillna is None else f"coalesce({col}, {T._q(fillna)})"

    keep = list(keep or [])
    sel = []
    for k in keep:
        if k not in columns:
            sel.append(f(k) + f" AS {k}" if k in {x.name for x in ARTICLE_SCHEMA.fields
                                                   if x.dataType.simpleString() == "string"}
                       else k)
    org_text = f"replace({f('orgao')}, '/', ' ')"
    tit_filled = T.sql_article_type(f("identifica"))
    for c in columns:
        if c == "titulo":
            t = tit_filled if ("tit_ementa_text" in columns or "tit_org_ementa_text" in columns) \
                else T.sql_article_type("identifica")
            sel.append(f"{t} AS titulo")
        elif c == "tipo_edicao":
            sel.append(f"{T.sql_edition_type('edicao')} AS tipo_edicao")
        elif c == "secao":
            sel.append("CAST(secao AS VARCHAR) AS secao")
        elif c == "ementa_text":
            sel.append(f"{f('ementa')} || ' ' || {f('fulltext')} AS ementa_text")
        elif c == "tit_ementa_text":
            sel.append(f"{tit_filled} || ' ' || {f('ementa')} || ' ' || {f('fulltext')} AS tit_ementa_text")
        elif c == "tit_org_ementa_text":
            sel.append(f"{tit_filled} || ' ' || {org_text} || ' ' || {f('ementa')} || ' ' || "
                       f"{f('fulltext')} AS tit_org_ementa_text")
        elif c == "org_ementa_text":
            sel.append(f"{org_text} || ' ' || {f('ementa')} || ' ' || {f('fulltext')} AS org_ementa_text")
        elif c == "orgaos":
            for i in range(1, (n_levels or 1) + 1):
                lv = f"string_split({f('orgao')}, '/')[{i}]"
                if fillna is not None:
                    lv = f"coalesce({lv}, {T._q(fillna)})"
                sel.append(f"{lv} AS {prefix}{i}")
        else:
            sel.append(f(c) + f" AS {c}")
    return f"SELECT {', '.join(sel)} FROM {source}"


# Text-normaliser settings of the two production configurations.
SECTION1_TEXT = dict(lowercase=False, punctuation=True, keep_cash=True, strip_accents=False,
                     only_letters=False, cargo_tokens=True, value_tokens=True)
SECTION2_TEXT = dict(lowercase=True, punctuation=True, keep_cash=True, strip_accents=False,
                     only_letters=False, cargo_tokens=True, value_tokens=True)


def normalize_columns(df: DataFrame, text_cols: list[str], stopwords=None, **opts) -> DataFrame:
    """TXT18 applied to every column of ``text_cols``."""
    return df.withColumns({c: T.normalize_text(c, stopwords=stopwords, **opts) for c in text_cols})


def section_features(df: DataFrame, section: int = 2, keep: list[str] | None = None,
                     text_col: str = "tit_org_ementa_text") -> DataFrame:
    """Preprocessing of the production models: edition type + one joined,
    normalised text column."""
    opts = SECTION1_TEXT if section == 1 else SECTION2_TEXT
    pre = preprocess_articles(df, ["tipo_edicao", text_col], fillna=K.NULL_TOKEN_SPACED,
                              keep=keep)
    return normalize_columns(pre, [text_col], stopwords=K.portuguese_stopwords(), **opts)


def sql_section_features(section: int = 2, keep: list[str] | None = None, source: str = "articles",
                         text_col: str = "tit_org_ementa_text") -> str:
    opts = SECTION1_TEXT if section == 1 else SECTION2_TEXT
    inner = sql_preprocess_articles(["tipo_edicao", text_col], fillna=K.NULL_TOKEN_SPACED,
                                    keep=keep, source=source)
    keep_sel = ", ".join(list(keep or []) + ["tipo_edicao"])
    norm = T.sql_normalize_text(text_col, stopwords=K.portuguese_stopwords(), **opts)
    return f"SELECT {keep_sel}, {norm} AS {text_col} FROM ({inner})"
