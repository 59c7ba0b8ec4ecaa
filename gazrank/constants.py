"""Fixed values that results depend on.

Everything in the block below is a FIXED VALUE: word lists, patterns and
numbers that must stay exactly as written for outputs to be right. They are
kept together, in their natural order, as plain text. Patterns are written
in the Python ``re`` dialect; :mod:`gazrank.functions.regex` converts them
to the Java (Spark) and RE2 (DuckDB oracle) dialects.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (do not edit)
# --------------------------------------------------------------------------

# Organisation names excluded from every selection cut (first path level and
# whole path).  The section-2 cut adds POWER_LEGISLATIVE.
EXCLUDED_ORGANS = [
    "Conselho Nacional do Ministério Público",
    "Entidades de Fiscalização do Exercício das Profissões Liberais",
    "Governo do Estado",
    "Ineditoriais",
    "Defensoria Pública da União",
    "Ministério Público da União",
    "Poder Judiciário",
    "Prefeituras",
    "Tribunal de Contas da União",
    "Atos do Poder Judiciário",
]
POWER_LEGISLATIVE = "Poder Legislativo"

# Lower-cased organisation substrings excluded from every cut.
EXCLUDED_ORGAN_WORDS = [
    "universidade",
    "instituto federal",
    "superintendência regional",
    "gerência regional",
    "superintendência estadual",
    "colégio",
]

# Section-1 title words (lower-cased LIKE '%w%').
SECTION1_TITLE_WORDS = ["decreto", "portaria", "resolu", "medida provisória", "lei "]

# Section-1 only, case-sensitive organisation substrings.
SECTION1_EXCLUDED_ORGAN_PARTS = [
    "Coordenação de Processos Migratórios",
    "Secretaria de Fomento e Incentivo à Cultura",
    "Departamento de Radiodifusão Comercial",
]

# Section-2 only: lower-cased organisation and full-text substrings.
SECTION2_EXCLUDED_ORGAN_WORDS = ["comando militar", "hospital"]
SECTION2_EXCLUDED_TEXT_WORDS = [
    "conceder aposentadoria",
    "aposentar",
    "conceder pensão",
    "afastamento do país",
]

# Title clean-up: literal replacements applied in this order.
TITLE_REPLACEMENTS = [
    ("julgamento", "julgamento "),
    ("adiamento", "adiamento "),
    ("licitação", "licitação "),
    ("adjudicação", "adjudicação "),
    ("homologação", "homologação "),
    ("suspensão", "suspensão "),
    ("prorrogação", "prorrogação "),
    ("homologado", "homologado "),
    ("retificação", "retificação "),
    ("alteração", "alteração "),
    ("revogação", "revogação "),
    ("habilitação", "habilitação "),
    ("pregão", " pregão"),
]
TITLE_DATE_PATTERN = r"de \d{1,2}[°º]? de [a-zç]{3,11} de \d{4}"
TITLE_NUMBER_PATTERN = r"n[°ºª] ?[0-9\.,/\-]*"

# Punctuation removed from text ('$' is added when cash is not kept); '/'
# becomes a space.
PUNCTUATION = "!\"#%&'()*+,-.:;<=>?@[\\]^_`{|}~"

# Portuguese accents stripped (other accented letters stay).
ACCENTS = [
    ("Ç", "C"), ("Ã", "A"), ("Á", "A"), ("À", "A"), ("Â", "A"), ("É", "E"),
    ("Ê", "E"), ("Í", "I"), ("Õ", "O"), ("Ó", "O"), ("Ô", "O"), ("Ú", "U"),
    ("Ü", "U"), ("ç", "c"), ("ã", "a"), ("á", "a"), ("à", "a"), ("â", "a"),
    ("é", "e"), ("ê", "e"), ("í", "i"), ("õ", "o"), ("ó", "o"), ("ô", "o"),
    ("ú", "u"), ("ü", "u"),
]
# Characters kept by the "only letters" filter (plus space and optional '$').
LETTERS = "a-zA-ZÁÂÃÀÉÊÍÔÓÕÚÜÇáâãàéêíóôõúüç"

# Brazilian money amounts (group 1 is the number), applied in this order.
VALUE_PATTERNS = [
    r"[rR]\$ ?(\d{1,3}(?:\.\d{3}){0,4}\,?\d{0,2})",
    r"(\d{1,3}(?:\.\d{3}){0,4}\,?\d{0,2}) (?:reais|REAIS|Reais)",
    r"(\d{1,3}(?:\.\d{3}){0,4},\d{2})(?:[^%]|$)",
]

# Public-post patterns and their tokens, case-insensitive, applied in order.
CARGO_PATTERNS = [
    (r"das[ -]*?[0123]{3}\.6", " xxdasseisxx "),
    (r"das[ -]*?[0123]{3}\.5", " xxdascincoxx "),
    (r"das[ -]*?[0123]{3}\.4", " xxdasquatroxx "),
    (r"das[ -]*?[0123]{3}\.3", " xxdastresxx "),
    (r"das[ -]*?[0123]{3}\.2", " xxdasdoisxx "),
    (r"das[ -]*?[0123]{3}\.1", " xxdasumxx "),
    (r"\Wca[ -]+?i(?:\W|$)", " xxcaixx "),
    (r"\Wca[ -]+?ii(?:\W|$)", " xxcaiixx "),
    (r"ca-apo[ -]*?1", " xxcaapoumxx "),
    (r"ca-apo[ -]*?2", " xxcaapodoisxx "),
    (r"\Wcdt\W", " xxcdtxx "),
    (r"ccd[ -]+?i(?:\W|$)", " xxccdixx "),
    (r"ccd[ -]+?ii(?:\W|$)", " xxccdiixx "),
    (r"cge[ -]+?i(?:\W|$)", " xxcgeixx "),
    (r"cge[ -]+?ii(?:\W|$)", " xxcgeiixx "),
    (r"cge[ -]+?iii(?:\W|$)", " xxcgeiiixx "),
    (r"cge[ -]+?iv(?:\W|$)", " xxcgeivxx "),
    (r"cge[ -]+?v(?:\W|$)", " xxcgevxx "),
    (r"cpaglo", " xxcpagloxx "),
    (r"\W(csp)(?:\W|$)", " xxcspxx "),
    (r"\W(csu)(?:\W|$)", " xxcsuxx "),
    (r"\Wcd(?:[ -]*?|\.)1(?:\W|$)", " xxcdumxx "),
    (r"\Wcd(?:[ -]*?|\.)2(?:\W|$)", " xxcddoisxx "),
    (r"\Wne(?:\W|$)", " xxnexx "),
    (r"cetg[ -]*?iv(?:\W|$)", " xxcetgivxx "),
    (r"cetg[ -]*?v(?:\W|$)", " xxcetgvxx "),
    (r"cetg[ -]*?vi(?:\W|$)", " xxcetgvixx "),
    (r"cetg[ -]*?vii(?:\W|$)", " xxcetgviixx "),
    (r"\Wfds[ -]*?1(?:\W|$)", " xxfdsumxx "),
    (r"fc?pe[ -]*?[0-9]{3}\.5", " xxfcpecincoxx "),
    (r"fc?pe[ -]*?[0-9]{3}\.4", " xxfcpequatroxx "),
    (r"fc?pe[ -]*?[0-9]{3}\.3", " xxfcpetresxx "),
    (r"fc?pe[ -]*?[0-9]{3}\.2", " xxfcpedoisxx "),
    (r"fc?pe[ -]*?[0-9]{3}\.1", " xxfcpeumxx "),
    (r"natureza especial", " xxnaturezaespecialxx "),
    (r"cne[ -]*?([0-9]{2})", r" xxcne\1xx "),
]
# What a text has to hold (small letters) for the post patterns that name it; the first that a pattern names counts.
CARGO_LITERALS = [("fc?pe", ("fpe", "fcpe")), ("ca[ -]+?i", ("ca ", "ca-")), ("cd(?:", ("cd",))] + [(x, (x,)) for x in (
    "das", "ca-apo", "cdt", "ccd", "cge", "cpaglo", "csp", "csu", "cetg", "fds", "natureza especial", "cne")]
# A quick test that every match of a post pattern without such a literal passes.
CARGO_TESTS = {r"\Wne(?:\W|$)": r"[nN][eE](?<=[^A-Za-z0-9_]..)(?![A-Za-z0-9_])"}
# Characters beside A-Z that match a small letter of a-z where case is ignored.
FOLDED_TO_ASCII = "\u017f\u212a\u0130\u0131"

# Certified-version boilerplate removed from full texts (section-1 workflow).
CERTIFIED_HEADER_PATTERN = r"^\s*?Versão certificada.*?Página: \d{1,3} Órgão: "
CERTIFIED_FOOTER_PATTERN = r"Este conteúdo não substitui o publicado na versão certificada."

# Null token: notebook form and production form.
NULL_TOKEN = "xxnuloxx"
NULL_TOKEN_SPACED = " xxnuloxx "

# Hash splits: share and removed prefix of the test split, then of the
# validation split.
TEST_FRAC = 0.15
TEST_PREFIX = "http://www.in.gov.br/web/dou/-/"
VAL_FRAC = 0.17
VAL_PREFIX = "http://www.in.gov.br/"

RELEVANT_LABELS = [4, 5]
SHUFFLE_SEED = 3911
SIM_THRESHOLD = 0.30
TEXT_LIMIT = 49990
POOL_MAX_DATE = "2020-04-25"
MONITOR_DATE = "2021-01-01"
DAS4_MAX_DATE = "2020-06-15"
DAS4_PATTERN = r"DAS[ -]*?[0123]{3}\.4"
DAS6_PATTERN = r"DAS[ -]*?[0123]{3}\.6"
DRIFT_BATCH = 200
BOOTSTRAP_TRIALS = 10

# Token pattern: two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Model settings.
SECTION1_RIDGE_ALPHA = 10000.0
SECTION2_RIDGE_ALPHA = 30.0
FOREST_TREES = 20
FOREST_DEPTH = 25
FOREST_SUBSAMPLE = 0.7
SECTION2_MIN_DF = 2
SECTION2_MAX_DF = 0.7
KMEANS_K = 100
SECTION1_ALPHA_GRID = [300.0, 1000.0, 3000.0, 10000.0, 30000.0, 100000.0]

# Keywords of the keyword-weighted vectorizer (section-2 notebook example)
# and anti keywords.
KEYWORDS = [
    "superior", "Ceder", "Assessor", "Coordenador-Geral", "EDUCAÇÃO", "MEIO AMBIENTE",
    "Tecnologia da Informação", "Pessoa com Deficiência", "TURISMO", "Cultura", "Mulheres",
    "Chefe de Gabinete", "Igualdade Racial", "xxcaiixx", "xxcaixx", "xxcddoisxx", "xxcdtxx",
    "xxcgeiiixx", "xxcgeiixx", "xxcgeivxx", "xxcgeixx", "xxcnexx", "xxdascincoxx", "xxdasdoisxx",
    "xxdasquatroxx", "xxdasseisxx", "xxdastresxx", "xxdasumxx", "xxfcpecincoxx", "xxfcpedoisxx",
    "xxfcpequatroxx", "xxfcpetresxx", "xxfcpeumxx", "xxnaturezaespecialxx",
    "xxnaturezaespecialxx xxnexx", "xxnexx", "substituto", "substituta", "substituir",
    "Diretor", "Secretário", "Diretora", "Secretária", "Superintendente-Geral",
    "Superintendente Regional", "Gerente Regional", "cargo de Secretário", "cargo de Secretária",
    "comissão de Secretário", "comissão de Secretária", "comissionada de Secretário",
    "comissionada de Secretária", "cargo de Diretor", "cargo de Diretora",
    "comissão de Diretor", "comissão de Diretora", "comissionada de Diretor",
    "comissionada de Diretora", "cargo de Ministro", "cargo de Ministra", "comissionado de Secretário",
    "comissionado de Secretária", "cargo de Coordenador-Geral", "comissionado de Coordenador-Geral",
    "comissão de Coordenador-Geral", "cargo de Assessor", "comissionado de Assessor",
    "comissão de Assessor", "cargo de Assessora", "comissionado de Assessora", "comissão de Assessora",
]
ANTI_KEYWORDS = ["cargo"]

# Portuguese stop words: Spark's public list for StopWordsRemover, in its order, plus "é".
PORTUGUESE_STOPWORDS = [
    "de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no",
    "se", "na", "por", "mais", "as", "dos", "como", "mas", "ao", "ele", "das", "à", "seu", "sua",
    "ou", "quando", "muito", "nos", "já", "eu", "também", "só", "pelo", "pela", "até", "isso",
    "ela", "entre", "depois", "sem", "mesmo", "aos", "seus", "quem", "nas", "me", "esse", "eles",
    "você", "essa", "num", "nem", "suas", "meu", "às", "minha", "numa", "pelos", "elas", "qual",
    "nós", "lhe", "deles", "essas", "esses", "pelas", "este", "dele", "tu", "te", "vocês", "vos",
    "lhes", "meus", "minhas", "teu", "tua", "teus", "tuas", "nosso", "nossa", "nossos", "nossas",
    "dela", "delas", "esta", "estes", "estas", "aquele", "aquela", "aqueles", "aquelas", "isto",
    "aquilo", "estou", "está", "estamos", "estão", "estive", "esteve", "estivemos", "estiveram",
    "estava", "estávamos", "estavam", "estivera", "estivéramos", "esteja", "estejamos", "estejam",
    "estivesse", "estivéssemos", "estivessem", "estiver", "estivermos", "estiverem", "hei", "há",
    "havemos", "hão", "houve", "houvemos", "houveram", "houvera", "houvéramos", "haja", "hajamos",
    "hajam", "houvesse", "houvéssemos", "houvessem", "houver", "houvermos", "houverem",
    "houverei", "houverá", "houveremos", "houverão", "houveria", "houveríamos", "houveriam",
    "sou", "somos", "são", "era", "éramos", "eram", "fui", "foi", "fomos", "foram", "fora",
    "fôramos", "seja", "sejamos", "sejam", "fosse", "fôssemos", "fossem", "for", "formos",
    "forem", "serei", "será", "seremos", "serão", "seria", "seríamos", "seriam", "tenho", "tem",
    "temos", "tém", "tinha", "tínhamos", "tinham", "tive", "teve", "tivemos", "tiveram", "tivera",
    "tivéramos", "tenha", "tenhamos", "tenham", "tivesse", "tivéssemos", "tivessem", "tiver",
    "tivermos", "tiverem", "terei", "terá", "teremos", "terão", "teria", "teríamos", "teriam", "é",
]

# --------------------------------------------------------------------------
# end of FIXED VALUES
# --------------------------------------------------------------------------


def portuguese_stopwords() -> tuple[str, ...]:
    """The stop-word list shared by the Spark expressions and the SQL oracle."""
    return tuple(PORTUGUESE_STOPWORDS)
