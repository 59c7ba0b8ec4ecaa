"""Line dedup, quality rules and url rules against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazrank.llm import line_dedup, quality_rules, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, extra string, n_lines string"

TEXTS = [
    "Header\nbody one\n\nfooter", "\tHEADER \nbody two\n", " header", "É x\nheader", "é x\nheader\nheader", None, "", "\n\n",
    "a" * 5000 + "\nheader", "solo", "solo", "x\u00a0\nheader",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "e", "clash") for i, t in enumerate(TEXTS)] + [(9, "solo", "e", "clash"), (None, "null id", "e", "clash")]
    return spark.createDataFrame(rows, SCHEMA)


def test_line_dedup_against_plain_python(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    often = Counter(k for _, ls in lines for k in {key(x) for x in ls})
    want = Counter()
    for i, ls in lines:
        kept = [x for x in ls if len(key(x)) < 1 or often[key(x)] < 3]
        want[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    out = line_dedup.drop_repeated_lines(docs, min_docs=3)
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped", "kept_text"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want


def test_line_dedup_min_chars_and_empty_table(docs):
    out = line_dedup.drop_repeated_lines(docs, min_docs=3, min_chars=7)
    assert out.agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def base(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts(spark, docs):
    eight = "a b c d e f g h"
    more = [eight + " x " + eight, " ".join(["k"] * 30), "\n".join(["same line here"] * 9) + " # $ |", "ñ é\x0b\u2003z " * 12]
    df = docs.unionByName(spark.createDataFrame([(100 + i, t, "e", "c") for i, t in enumerate(more)], SCHEMA))
    out = quality_rules.judge(df, [0.0] * 64)
    for r in out.collect():
        n, chars, symbols, dup, repeat = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.text
        failed = n < 20 or 100 * repeat > 30 * n
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules.judge(df.limit(0), [0.0] * 64).count() == 0


def test_quality_model_tells_trusted_from_junk(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(30)]
    junk = [(100 + i, " ".join(rng.choice("stuvwxyz") for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:15]] + [(i, 0, 0) for i, _ in junk[:15]] + [(0, None, None)],
                                   "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, labels, buckets=1 << 12, prior=5.0))
    score = {r.doc_id: r.score for r in judged.collect()}
    assert min(score[i] for i, _ in good) > max(score[i] for i, _ in junk)
    kept = quality_rules.keep_good(judged)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.filter("kept").collect()}
    assert set(quality_rules.fit(docs, labels.limit(0), buckets=16)) == {0.0}


def test_host_path_and_list_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    urls = ["http://A.Example.ORG/es/5", "https://example.org/en/12?x#y", "http://x.org", "http://x.org/", "http://a.com/de/",
            "http://a.com/DE/", "http://notcom/de/", "nothing", None, "", "a://b://c.com/fr/", "http://é.COM/fr/?q", "http://a.com/de/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate(LOWER)
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    out = url_rules.judge_urls(pages, labels, rules)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: plain(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.limit(0), labels, rules).count() == 0


def test_mined_rules_against_counting(spark):
    urls = [f"http://{'spam' if i % 3 == 0 else 'news'}.net/{'win' if i % 2 == 0 else 'read'}/{i}?ref=1" for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = lambda i: i % 3 == 0 and i % 2 == 0 and i % 30 != 0  # noqa: E731  spam + win, mostly
    labels = spark.createDataFrame([(i, 0 if bad(i) else 1, 0) for i in range(0, 100)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    out = url_rules.judge_urls(pages, labels, [], min_support=0.01, min_count=5, min_confidence=0.7)
    got = {r.page_id for r in out.filter("verdict = 'block'").collect()}
    assert got == {i for i in range(120) if i % 6 == 0}  # unlabelled and labelled alike
    rules = url_rules.mine_rules(pages.withColumn("bad", F.col("page_id").isin([i for i in range(120) if bad(i)])),
                                 0.01, 5, 0.7)
    for r in rules.collect():
        tokens = set(r.tokens)
        has = [i for i, u in enumerate(urls) if tokens <= ({"h=" + x for x in u[7:].split("/")[0].split(".")}
                                                          | {"p=" + x for x in u.split("?")[0][7:].split("/")[1:]} | {"q=ref"})]
        hits = [i for i in has if bad(i)]
        assert abs(r.confidence - len(hits) / len(has)) < 1e-9 and len(hits) >= 5


def test_rules_stay_few(spark):
    keys = "&".join(f"k{i}=1" for i in range(30))
    urls = [f"http://hot.net/a?{keys}"] * 40 + [f"http://hot.net/b{i}?{keys}&own{i}=2" for i in range(12)]
    urls += [f"http://x{i}.com/k{i % 30}?k{i % 30}=3" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 52 else 1, 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(pages.withColumn("bad", F.col("page_id") < 52))
    assert 1 <= rules.count() <= 60
    out = url_rules.judge_urls(pages.unionByName(spark.createDataFrame([(900, "http://hot.net/new"), (901, "http://y.com/" + "z/" * 20000)],
                                                                       "page_id long, url string")), labels, [])
    got = {r.page_id: r.verdict for r in out.collect()}
    assert all(got[i] == "block" for i in range(52)) and all(got[i] == "allow" for i in range(52, len(urls)))
    assert got[900] == "block" and got[901] == "allow"


def test_no_token_of_a_long_url_is_left_out(spark):
    import itertools
    import random
    draw = random.Random(4)
    sets, bad = [], []
    for i in range(400):
        has = {k for k in range(16) if draw.random() < 0.55} | {20 + i % 7}
        sets.append(has)
        bad.append({2, 9, 14} <= has or draw.random() < 0.08)
    urls = ["http://one.net/?" + "&".join(f"{k:02}={i}" for k in sorted(s)) + f"#{i}" for i, s in enumerate(sets)]
    pages = spark.createDataFrame([(u, b) for u, b in zip(urls, bad, strict=True)], "url string, bad boolean")
    got = {tuple(r.tokens): (r.confidence, r.support) for r in url_rules.mine_rules(pages, 0.01, 20, 0.6, 3.0, max_tokens=None).collect()}
    rows = {}
    for s, b in zip(sets, bad, strict=True):
        rows[frozenset(s), b] = 1
    n, n_bad = len(rows), sum(b for _, b in rows)
    base = n_bad / n

    def rule(t):
        own = [b for s, b in rows if set(t) <= s]
        c = sum(own) / max(len(own), 1)
        ok = sum(own) >= 20 and c >= 0.6 and (c - base) / (base * (1 - base) / len(own)) ** 0.5 >= 3.0
        return (c, sum(own) / n) if ok else None

    every = {t: r for size in (1, 2, 3, 4, 5) for t in itertools.combinations(range(27), size) if (r := rule(t))}
    least = {t: r for t, r in every.items()
             if not any(every.get(p, (0,))[0] >= r[0] for size in range(1, len(t)) for p in itertools.combinations(t, size))}
    named = {tuple(int(x[2:]) for x in t): r for t, r in got.items()}
    assert (2, 9, 14) in least and {t: r for t, r in named.items() if len(t) <= 5} == least


def test_minimal_rules(spark):
    rules = spark.createDataFrame([(["a"], 0.8, 0.1), (["a", "b"], 0.8, 0.1), (["a", "c"], 0.9, 0.1), (["b", "c"], 0.7, 0.1),
                                   (["b", "c", "d"], 0.7, 0.1)], "tokens array<string>, confidence double, support double")
    assert {tuple(r.tokens) for r in url_rules.minimal(rules).collect()} == {("a",), ("a", "c"), ("b", "c")}


def test_hash_of_kept_text(spark):
    out = line_dedup.drop_repeated_lines(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert out.select(F.sha2("kept_text", 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_line_dedup_counts_ids_once(spark):
    rows = [(1, "own line")] * 10 + [(i, "shared line") for i in range(2, 5)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3, count_ids=True).collect()
    assert len(out) == 13 and {(r.doc_id, r.kept_text) for r in out} == {(1, "own line"), (2, ""), (3, ""), (4, "")}
