"""Text and hash expressions (TXT*), as pure ``Column -> Column`` functions.

Every function here is a chain of built-in Spark expressions: no Python UDF,
so the whole article normaliser runs inside whole-stage codegen.  Each Spark
function has an ``sql_*`` twin producing the DuckDB SQL text of the same
expression (used by the oracle).
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import regex as R

MARK = "\u0001"  # marks numbers inside text while they are tokenised


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --------------------------------------------------------------------------
# whitespace
# --------------------------------------------------------------------------

def collapse_ws(c) -> Column:
    """``' '.join(s.split())``: runs of Unicode whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), R.java(R.WS + "+"), " "))


def sql_collapse_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, {_q(R.re2(R.WS + '+'))}, ' ', 'g'))"


# --------------------------------------------------------------------------
# TXT1 edition type
# --------------------------------------------------------------------------

def edition_type(c="edicao") -> Column:
    """'Extra' if the edition (as text; null -> 'nan') has a '-'."""
    s = F.coalesce(_c(c).cast("string"), F.lit("nan"))
    return F.when(s.contains("-"), F.lit("Extra")).otherwise(F.lit("Ordinária"))


def sql_edition_type(e: str = "edicao") -> str:
    return f"CASE WHEN contains(coalesce(CAST({e} AS VARCHAR), 'nan'), '-') THEN 'Extra' ELSE 'Ordinária' END"


# --------------------------------------------------------------------------
# TXT2 article type from the title
# --------------------------------------------------------------------------

def article_type(c="identifica") -> Column:
    s = collapse_ws(F.lower(_c(c)))
    s = F.regexp_replace(s, R.java(K.TITLE_DATE_PATTERN), "")
    s = F.regexp_replace(s, R.java(K.TITLE_NUMBER_PATTERN), "")
    s = F.translate(s, "/|", "  ")
    for old, new in K.TITLE_REPLACEMENTS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.coalesce(collapse_ws(s), F.lit(""))


def sql_article_type(e: str = "identifica") -> str:
    s = sql_collapse_ws(f"lower({e})")
    s = f"regexp_replace({s}, {_q(R.re2(K.TITLE_DATE_PATTERN))}, '', 'g')"
    s = f"regexp_replace({s}, {_q(R.re2(K.TITLE_NUMBER_PATTERN))}, '', 'g')"
    s = f"translate({s}, '/|', '  ')"
    for old, new in K.TITLE_REPLACEMENTS:
        s = f"replace({s}, {_q(old)}, {_q(new)})"
    return f"coalesce({sql_collapse_ws(s)}, '')"


# --------------------------------------------------------------------------
# TXT3 / TXT4 hierarchy levels
# --------------------------------------------------------------------------

def count_levels(c="orgao", splitter: str = "/") -> Column:
    return F.size(F.split(_c(c), _java_literal(splitter)))


def level(c, i: int, splitter: str = "/") -> Column:
    """Level ``i`` (1-based) of a path, null when the path is shorter."""
    return F.get(F.split(_c(c), _java_literal(splitter)), i - 1)


def _java_literal(s: str) -> str:
    import re as _re
    return _re.escape(s)


# --------------------------------------------------------------------------
# TXT8 punctuation, TXT11 accents, TXT12 only letters
# --------------------------------------------------------------------------

def _punct(keep_cash: bool) -> str:
    return K.PUNCTUATION + ("" if keep_cash else "$")


def remove_punctuation(c, keep_cash: bool = True) -> Column:
    """'/' becomes a space, punctuation is deleted."""
    return F.translate(_c(c), "/" + _punct(keep_cash), " ")


def sql_remove_punctuation(e: str, keep_cash: bool = True) -> str:
    return f"translate({e}, {_q('/' + _punct(keep_cash))}, ' ')"


_ACC_FROM = "".join(a for a, _ in K.ACCENTS)
_ACC_TO = "".join(b for _, b in K.ACCENTS)


def remove_accents(c) -> Column:
    return F.translate(_c(c), _ACC_FROM, _ACC_TO)


def sql_remove_accents(e: str) -> str:
    return f"translate({e}, {_q(_ACC_FROM)}, {_q(_ACC_TO)})"


def _letters_class(keep_cash: bool) -> str:
    return "[^" + K.LETTERS + " " + ("\\$" if keep_cash else "") + "]"


def keep_only_letters(c, keep_cash: bool = True) -> Column:
    """Delete everything but letters, space (and '$'); newlines are deleted."""
    # Java looks single characters of a class up in one table, ranges one after the other.
    each = K.LETTERS.replace("a-z", string.ascii_lowercase).replace("A-Z", string.ascii_uppercase)
    return collapse_ws(F.regexp_replace(_c(c), _letters_class(keep_cash).replace(K.LETTERS, each), ""))


def sql_keep_only_letters(e: str, keep_cash: bool = True) -> str:
    return sql_collapse_ws(f"regexp_replace({e}, {_q(_letters_class(keep_cash))}, '', 'g')")


# --------------------------------------------------------------------------
# TXT9 stop words
# --------------------------------------------------------------------------

def remove_stopwords(c, stopwords) -> Column:
    """Split on whitespace, drop stop words (exact case), join by one space."""
    words = F.split(collapse_ws(c), " ")
    stop = list(stopwords)
    return F.array_join(F.filter(words, lambda w: ~w.isin(stop)), " ")


def sql_remove_stopwords(e: str, stopwords) -> str:
    lst = ", ".join(_q(w) for w in stopwords)
    return (f"array_to_string(list_filter(string_split({sql_collapse_ws(e)}, ' '), "
            f"lambda w: w NOT IN ({lst})), ' ')")


# --------------------------------------------------------------------------
# TXT13 - TXT15 money amounts to magnitude tokens
# --------------------------------------------------------------------------

def num_to_scale(x, base: float = 2.0) -> Column:
    """``int(round_half_even(log_base(max(x, 1))))``."""
    return F.bround(F.log(float(base), F.greatest(_c(x).cast("double"), F.lit(1.0))), 0).cast("int")


def sql_num_to_scale(e: str, base: float = 2.0) -> str:
    return f"CAST(round_even(ln(greatest(CAST({e} AS DOUBLE), 1.0)) / ln({float(base)}), 0) AS INTEGER)"


def _br_number(e: Column) -> Column:
    return F.replace(F.replace(e, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double")


def scale_token(number_text: Column) -> Column:
    """TXT14: ' xx' + 'v' * scale + 'xx ' for a Brazilian-format number."""
    return F.concat(F.lit(" xx"), F.repeat(F.lit("v"), num_to_scale(_br_number(number_text))),
                    F.lit("xx "))


def _sql_scale_token(e: str) -> str:
    num = f"CAST(replace(replace({e}, '.', ''), ',', '.') AS DOUBLE)"
    return f"(' xx' || repeat('v', {sql_num_to_scale(num)}) || 'xx ')"


def values_to_token(c, patterns=K.VALUE_PATTERNS) -> Column:
    """TXT15: replace each money amount by its magnitude token.

    Each pattern ``A(NUM)B`` is rewritten ``(A)(NUM)(B)`` and the number is
    fenced with a control mark; the text is split at the marks and every
    second piece (a number) becomes its token.  All native expressions.
    """
    s = _c(c)
    for p in patterns:
        a, g, b = R.split_group(p)
        pat = R.java("(" + a + ")(" + g + ")(" + b + ")")
        s = F.regexp_replace(s, pat, "$1" + MARK + "$2" + MARK + "$3")
        parts = F.split(s, MARK)
        s = F.array_join(F.transform(parts, lambda e, i: F.when(i % 2 == 1, scale_token(e))
                                     .otherwise(e)), "")
    return s


def sql_values_to_token(e: str, patterns=K.VALUE_PATTERNS) -> str:
    s = e
    for p in patterns:
        a, g, b = R.split_group(p)
        pat = R.re2("(" + a + ")(" + g + ")(" + b + ")")
        s = f"regexp_replace({s}, {_q(pat)}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
        s = (f"array_to_string(list_transform(string_split({s}, chr(1)), lambda x, i: "
             f"CASE WHEN i % 2 = 0 THEN {_sql_scale_token('x')} ELSE x END), '')")
    return s


# --------------------------------------------------------------------------
# TXT16 / TXT17 post tokens
# --------------------------------------------------------------------------

def regex_sub_ci(c, pattern: str, repl: str) -> Column:
    """TXT16: case-insensitive regex replacement (Python dialect in)."""
    return F.regexp_replace(_c(c), R.java(pattern, ignore_case=True), R.java_replacement(repl))


def sql_regex_sub_ci(e: str, pattern: str, repl: str) -> str:
    return (f"regexp_replace({e}, {_q(R.re2(pattern, ignore_case=True))}, "
            f"{_q(R.re2_replacement(repl))}, 'g')")


def _bound(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body names it."""
    return F.transform(F.array(c), body)[0]


def _cargo_groups(table) -> list[tuple[tuple, list]]:
    """Neighbouring patterns that need the same literals: ``(literals, patterns)``; no literals if none is known.

    Literals are looked for in the text before any replacement. A token has spaces around, so a literal that comes up later lies
    within a token, and the literals of that token's patterns count too. (The space of "ca " cannot be a token's: no token
    begins with "i" or "-".)
    """
    groups: list[tuple[tuple, list]] = []
    for pat, tok in table:
        own = next((ls for name, ls in K.CARGO_LITERALS if name in pat), ())
        if groups and groups[-1][0] == own:
            groups[-1][1].append((pat, tok))
        else:
            groups.append((own, [(pat, tok)]))
    needs: list[tuple] = []
    for n, (own, _) in enumerate(groups):
        before = [needs[m] for m in range(n) if any(x in tok for x in own for _, tok in groups[m][1])]
        needs.append(() if not own or () in before else tuple(dict.fromkeys([*own, *[x for b in before for x in b]])))
    return [(need, rows) for need, (_, rows) in zip(needs, groups, strict=True)]


def tokenize_cargos(c, table=K.CARGO_PATTERNS) -> Column:
    """TXT17: the patterns one after the other. Of the fixed table, those whose literals the text does not
    hold are not tried: a plain search is many times cheaper than a pattern without regard to case."""
    if table is not K.CARGO_PATTERNS:
        s = _c(c)
        for pat, tok in table:
            s = regex_sub_ci(s, pat, tok)
        return s

    def replaced(s: Column, rows: list) -> Column:
        for pat, tok in rows:
            if pat in K.CARGO_TESTS:
                s = _bound(s, lambda x: F.when(x.rlike(K.CARGO_TESTS[pat]), regex_sub_ci(x, pat, tok)).otherwise(x))
            elif pat[:-1].endswith(r"{3}\."):  # a level: ends in a point and this digit
                s = _bound(s, lambda x: F.when(x.contains(pat[-2:]), regex_sub_ci(x, pat, tok)).otherwise(x))
            else:
                s = regex_sub_ci(s, pat, tok)
        return s

    def guarded(s: Column, held: Column, rows: list) -> Column:
        return _bound(s, lambda x: F.when(held, replaced(x, rows)).otherwise(x))

    def chain(text: Column, low: Column) -> Column:
        s = text
        for needs, rows in _cargo_groups(table):
            if needs:
                held = F.lit(False)
                for x in needs:
                    held = held | low.contains(x)
                for x in K.FOLDED_TO_ASCII:
                    held = held | text.contains(x)
                s = guarded(s, held, rows)
            else:
                s = replaced(s, rows)
        return s

    return _bound(_c(c), lambda text: _bound(F.lower(text), lambda low: chain(text, low)))


def sql_tokenize_cargos(e: str, table=K.CARGO_PATTERNS) -> str:
    s = e
    for pat, tok in table:
        s = sql_regex_sub_ci(s, pat, tok)
    return s


# --------------------------------------------------------------------------
# TXT18 whole text normaliser
# --------------------------------------------------------------------------

def normalize_text(c, lowercase=True, value_tokens=True, punctuation=True, keep_cash=True,
                   stopwords=None, strip_accents=True, only_letters=True,
                   cargo_tokens=True) -> Column:
    """Order: posts, lowercase, values, punctuation, stop words, accents,
    letters.  (Stemming is a separate, optional stage.)"""
    s = _c(c)
    if cargo_tokens:
        s = tokenize_cargos(s)
    if lowercase:
        s = F.lower(s)
    if value_tokens:
        s = values_to_token(s)
    if punctuation:
        s = remove_punctuation(s, keep_cash)
    if stopwords is not None:
        s = remove_stopwords(s, stopwords)
    if strip_accents:
        s = remove_accents(s)
    if only_letters:
        s = keep_only_letters(s, keep_cash)
    return s


def sql_normalize_text(e: str, lowercase=True, value_tokens=True, punctuation=True,
                       keep_cash=True, stopwords=None, strip_accents=True, only_letters=True,
                       cargo_tokens=True) -> str:
    s = e
    if cargo_tokens:
        s = sql_tokenize_cargos(s)
    if lowercase:
        s = f"lower({s})"
    if value_tokens:
        s = sql_values_to_token(s)
    if punctuation:
        s = sql_remove_punctuation(s, keep_cash)
    if stopwords is not None:
        s = sql_remove_stopwords(s, stopwords)
    if strip_accents:
        s = sql_remove_accents(s)
    if only_letters:
        s = sql_keep_only_letters(s, keep_cash)
    return s


# --------------------------------------------------------------------------
# TXT20 certified-version boilerplate
# --------------------------------------------------------------------------

def clean_certified(c="fulltext") -> Column:
    s = F.regexp_replace(_c(c), R.java(K.CERTIFIED_HEADER_PATTERN), "")
    return F.regexp_replace(s, R.java(K.CERTIFIED_FOOTER_PATTERN), "")


def sql_clean_certified(e: str = "fulltext") -> str:
    s = f"regexp_replace({e}, {_q(R.re2(K.CERTIFIED_HEADER_PATTERN))}, '', 'g')"
    return f"regexp_replace({s}, {_q(R.re2(K.CERTIFIED_FOOTER_PATTERN))}, '', 'g')"


# --------------------------------------------------------------------------
# TXT21 CRC32 hash, TXT22 log10(1+x)
# --------------------------------------------------------------------------

def hash_string(c, prefix: str = "") -> Column:
    """CRC32 of the UTF-8 text after removing every occurrence of ``prefix``."""
    s = _c(c)
    if prefix:
        s = F.replace(s, F.lit(prefix), F.lit(""))
    return F.crc32(s.cast("binary"))


def sql_crc32(e: str) -> str:
    """CRC32 of ASCII text in plain DuckDB SQL (no built-in exists)."""
    return ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split("
            + e + ", ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend("
            "xor(c, b), list_transform(range(8), lambda z: z::BIGINT)), lambda a, z: CASE WHEN "
            "a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)")


def sql_hash_string(e: str, prefix: str = "") -> str:
    if prefix:
        e = f"replace({e}, {_q(prefix)}, '')"
    return sql_crc32(e)


def log10_one_plus(c) -> Column:
    return F.log10(F.lit(1.0) + _c(c))


# --------------------------------------------------------------------------
# TXT24 / TXT25 tokens and n-grams
# --------------------------------------------------------------------------

def tokens(c) -> Column:
    """Tokens of two or more word characters (one-char tokens dropped)."""
    return F.regexp_extract_all(_c(c), F.lit(R.java(K.TOKEN_PATTERN)), 0)


def sql_tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {_q(R.re2(K.TOKEN_PATTERN))})"


def _join_fields(n: int):
    # a one-argument lambda: F.transform passes (element, index) to two-argument ones
    return lambda s: F.concat_ws(" ", *[s[f"g{k}"] for k in range(n)])


def ngrams(tok, n_min: int = 1, n_max: int = 1) -> Column:
    """Word n-grams ``n_min..n_max`` over a token array, unigrams first.

    An n-gram array is built from n shifted slices of the token array
    (``zip_with`` / ``arrays_zip``): the token array is an argument, never
    referenced inside a lambda, so it is evaluated once per row rather than
    once per position.
    """
    tok = _c(tok)
    out = None
    for n in range(n_min, n_max + 1):
        if n == 1:
            g = tok
        else:
            m = F.greatest(F.size(tok) - (n - 1), F.lit(0))
            parts = [F.slice(tok, k + 1, m) for k in range(n)]
            if n == 2:
                g = F.zip_with(parts[0], parts[1], lambda a, b: F.concat(a, F.lit(" "), b))
            else:
                z = F.arrays_zip(*[p.alias(f"g{k}") for k, p in enumerate(parts)])
                g = F.transform(z, _join_fields(n))
        out = g if out is None else F.concat(out, g)
    return out


def sql_ngrams(e: str, n_min: int = 1, n_max: int = 1) -> str:
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(e)
        else:
            parts.append(f"CASE WHEN len({e}) >= {n} THEN list_transform(range(1, len({e}) - {n - 2}), "
                         f"lambda i: array_to_string({e}[i:i + {n - 1}], ' ')) ELSE [] END")
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"
