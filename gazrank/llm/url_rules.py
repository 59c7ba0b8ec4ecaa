"""URL filtering by lists of rules and by mined association rules.

Method: each labelled page's url becomes a set of tokens (domain labels, path
segments, query keys) plus, if the page is labelled bad, one marker. Spark's
FP-growth mines the frequent combinations; rules ``tokens -> marker`` with
enough support and confidence are kept. Both kinds of rule are posted in one
inverted index (a list rule under its host, a mined rule under its rarest
token), which the distinct urls join; what remains of a rule is then checked.

What keeps the rules few: a set of tokens counts once, tokens that only occur together are one, and
a rule of which a part says the same is left out. No token of a url is left out: where urls have too many
for all combinations, combinations are made longer step by step, and only where they tell more than their parts.

Scale: each distinct url is judged once, however many pages have it. Mined
rules sit under rare tokens, so a token that most urls have has no long
posting. The list of rules is a parameter and is broadcast. The join back to the pages is by url, where the adaptive skew join
splits a hot url's pages. DataFrame functions and MLlib only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MARKER = "label=bad"
#: Tokens of a set up to which all of their combinations are made.
MOST_COMBINED = 10
#: (host, path prefix, verdict)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """From the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return C.ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct ``h=`` domain labels, ``p=`` path segments and ``q=`` query keys."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    return F.array_distinct(F.concat(
        tagged("h=", F.split(host, r"\.")), tagged("p=", F.split(path, "/")),
        tagged("q=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))))


def _features(urls: DataFrame) -> DataFrame:
    df = urls.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    return df.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))


def token_classes(sets: DataFrame) -> DataFrame:
    """``token``, ``class``: tokens that the same rows of ``sets`` (different arrays ``tokens``) have are one
    class, named by its first token. Equal covers are told by their size and two 64-bit sums of hashes."""
    each = sets.select(F.explode("tokens").alias("token"), F.xxhash64(F.lit(5), "tokens").alias("x"), F.xxhash64(F.lit(7), "tokens").alias("y"))
    cover = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    first = cover.groupBy("n", "a", "b").agg(F.min("token").alias("class"))
    return cover.join(first, ["n", "a", "b"]).select("token", "class")


def classed(sets: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``key`` and ``classes``: the distinct classes of each row's ``tokens`` (rows without any are left out)."""
    return (sets.select(key, F.explode("tokens").alias("token")).join(classes, "token")
            .groupBy(key).agg(F.sort_array(F.collect_set("class")).alias("classes")))


def _grown(chosen: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """Combinations (``tokens``, ``hits``, ``own``) of the classes of each set in ``chosen``, by FP-growth."""
    mark = F.when(F.col("bad"), F.array(F.lit(MARKER))).otherwise(F.array().cast("array<string>"))
    rows = C.stored(chosen.groupBy("tokens", "bad").agg(F.collect_list("class").alias("c")).select(F.concat("c", mark).alias("items")),
                    "url-items")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(rows.count(), 1)), minConfidence=min_confidence).fit(rows)
    together = model.freqItemsets.filter(F.array_contains("items", MARKER) & (F.size("items") > 2)).select(
        F.array_sort(F.array_remove("items", MARKER)).alias("tokens"), F.col("freq").alias("hits"))
    own = model.freqItemsets.filter(~F.array_contains("items", MARKER)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("own"))
    return together.join(own, "tokens")


def levels(sets: DataFrame, single: DataFrame, least: float) -> DataFrame:
    """All combinations (``tokens``, ``hits``, ``own``) of two tokens or more that can be a minimal rule, however long the sets are.

    ``sets`` has different sorted arrays ``items``, each with the number of sets (``own``) and of bad ones (``hits``); ``single`` has the
    counts of its tokens. A combination is extended only while each part of it occurs in more sets (else the part says
    the same, and so for everything longer) and not all of its sets are bad (nothing longer is surer).
    """
    sets = C.stored(sets.withColumn("sid", F.monotonically_increasing_id()), "url-levels")
    known = single.select(F.array("class").alias("tokens"), "own").filter(F.col("own") > F.col("hits"))
    held = sets.select("sid", F.explode("items").alias("last")).join(known.select(F.get("tokens", F.lit(0)).alias("last")), "last")
    held, out, size = held.select("sid", F.array("last").alias("tokens")), None, 1
    while True:
        size += 1
        longer = held.join(sets, "sid").select("sid", "own", "hits", "tokens", F.explode(
            F.filter("items", lambda x: x > F.element_at("tokens", -1))).alias("last"))
        longer = C.stored(longer.select("sid", "own", "hits", F.concat("tokens", F.array("last")).alias("tokens")), "url-longer")
        counts = longer.groupBy("tokens").agg(F.sum("own").alias("own"), F.sum("hits").alias("hits")).filter(F.col("hits") >= least)
        parts = counts.select("tokens", "hits", "own", F.explode(F.transform(
            "tokens", lambda x: F.filter("tokens", lambda y: y != x))).alias("part"))
        more = known.select(F.col("tokens").alias("part"), F.col("own").alias("wider"))
        kept = C.stored(parts.join(more, "part").filter(F.col("wider") > F.col("own")).groupBy("tokens", "hits", "own")
                        .agg(F.count("*").alias("n")).filter(F.col("n") == size).drop("n"), "url-kept")
        out = kept if out is None else out.unionByName(kept)
        known = kept.filter(F.col("own") > F.col("hits")).select("tokens", "own")
        if known.isEmpty():
            return out
        held = longer.join(known.select("tokens"), "tokens", "left_semi").select("sid", "tokens")


def mine(labelled: DataFrame, min_support: float = 0.0005, min_count: int = 5, min_confidence: float = 0.5,
         min_z: float = 2.0, max_tokens: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """Rules (``tokens``, ``confidence``, ``support``) from rows of ``url`` and ``bad`` (boolean), and the classes of tokens.

    What is counted are different sets of tokens with their label: a url on many pages counts once, or each of its
    tokens' combinations would be frequent by itself. Tokens that only occur together are one class, named in the rules by
    its first token. A rule's tokens occur together with bad in ``min_support`` of the sets and in ``min_count`` at
    least, with a confidence that lies ``min_z`` standard errors above the share of bad sets. A token that is a
    rule by itself is combined with no other, since each url that has both is blocked already; of the rest, the ``max_tokens``
    of each set that stand most above the share of bad sets are combined (for a short list of rules). With None all are: by FP-growth
    while no set has more than ``MOST_COMBINED`` that occur with bad often enough, since it gives every combination, else by
    :func:`levels`, which gives those that a minimal rule can be. Only minimal rules stay. Rows with a null url or label do not count.
    """
    known = _features(labelled.filter("url is not null and bad is not null"))
    sets = C.stored(known.select(F.array_sort("tokens").alias("tokens"), "bad").distinct(), "url-sets")
    classes = C.stored(token_classes(sets.select("tokens").distinct()), "url-classes")
    each = sets.select("tokens", "bad", F.explode("tokens").alias("token")).join(classes, "token").select("tokens", "bad", "class").distinct()
    n, n_bad = sets.agg(F.count("*"), F.count_if("bad")).first()
    n, base = max(n, 1), n_bad / max(n, 1)
    least = max(min_support * n, min_count)
    # Confidence against the share of bad sets; ``own`` sets have the tokens.
    z = lambda confidence, own: (confidence - base) / F.sqrt(F.lit(max(base * (1 - base), 1e-12)) / own)
    counts = each.groupBy("class").agg(F.count("*").alias("own"), F.count_if("bad").alias("hits"))
    single = C.stored(counts.select("class", "own", "hits", (F.col("hits") / F.col("own")).alias("confidence"),
                                    z(F.col("hits") / F.col("own"), F.col("own")).alias("z"))
                      .withColumn("rule", (F.col("hits") >= least) & (F.col("confidence") >= min_confidence) & (F.col("z") >= min_z)),
                      "url-singles")
    open_ = single.filter(~F.col("rule"))
    if max_tokens is None:  # what is rarer with bad is part of no rule
        open_ = open_.filter(F.col("hits") >= least)
        chosen = C.stored(each.join(open_.select("class"), "class"), "url-open")
        longest = chosen.groupBy("tokens", "bad").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    else:
        best = Window.partitionBy("tokens", "bad").orderBy(F.desc("z"), "class")
        chosen = (each.join(open_.select("class", "z"), "class")
                  .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_tokens))
        longest = 0
    if longest > MOST_COMBINED:
        sets = chosen.groupBy("tokens", "bad").agg(F.sort_array(F.collect_list("class")).alias("items")).groupBy("items").agg(
            F.count("*").alias("own"), F.count_if("bad").alias("hits"))
        found = levels(sets, open_, least)
    else:
        found = _grown(chosen, least, min_confidence)
    combined = found.withColumn("confidence", F.col("hits") / F.col("own")).filter(
        (F.col("confidence") >= min_confidence) & (z(F.col("confidence"), F.col("own")) >= min_z))
    rules = single.filter("rule").select(F.array("class").alias("tokens"), "confidence", "hits").unionByName(
        combined.select("tokens", "confidence", "hits"))
    return minimal(C.stored(rules.select("tokens", "confidence", (F.col("hits") / n).alias("support")), "url-rules")), classes


def mine_rules(labelled: DataFrame, *args, **settings) -> DataFrame:
    """The rules of :func:`mine`."""
    return mine(labelled, *args, **settings)[0]


def minimal(rules: DataFrame) -> DataFrame:
    """The rules of which no part (fewer of the tokens) has at least their confidence.

    A part is met under its first token, which the rule has too.
    """
    parts = rules.select(F.get("tokens", F.lit(0)).alias("first"), F.col("tokens").alias("part"), F.col("confidence").alias("less"))
    whole = rules.select(F.explode("tokens").alias("first"), "tokens", "confidence")
    covers = ((F.size("part") < F.size("tokens")) & (F.col("less") >= F.col("confidence"))
              & (F.size(F.array_except("part", "tokens")) == 0))
    gone = whole.join(parts, "first").filter(covers).select("tokens").distinct()
    return rules.join(gone, "tokens", "left_anti")


def prune_rules(rules: DataFrame, tokens_of: DataFrame) -> DataFrame:
    """Post each rule under its rarest token: ``token``, ``tokens``.

    ``tokens_of`` has the column ``tokens`` of every distinct url. Ties go to
    the token that is first in the alphabet.
    """
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    counts = (tokens_of.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n")))
    return (each.join(counts, "token", "left").groupBy("tokens")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("first"))
            .select(F.col("first.token").alias("token"), "tokens"))


def judge_urls(pages: DataFrame, labels: DataFrame, list_rules: list[Rule], id_col: str = "page_id",
               url: str = "url", **mining) -> DataFrame:
    """Input columns plus ``host``, ``path``, ``rule`` (null if none), ``verdict``, ``mined`` (boolean).

    ``labels`` has ``doc_id``, ``quality``, ``toxic``: a page is bad if a label
    of its id says quality 0 or toxic 1. The longest fitting list rule decides
    (equal ones: block first, then by rule text); else a url that some mined
    rule matches is blocked, and any other is allowed.

    * null url or no ``://``: empty host and path, no rule, allowed; a very long url is one like any other.
    * no labels, or nothing frequent enough: no mined rules.
    * repeated rows come back one by one; an empty table gives an empty table;
      input columns named like the new ones are replaced.
    """
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col(url).alias("url"), F.col(id_col).alias("id"))
    urls = C.stored(_features(rows.filter("url is not null").select("url").distinct()), "urls")
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules, classes = mine(rows.join(bad, "id").select("url", "bad"), **{"max_tokens": None, **mining})
    rules = C.stored(rules, "url-minimal")
    # The urls' classes, as far as rules name them; a url has a class if it has any of its tokens.
    needed = classes.join(rules.select(F.explode("tokens").alias("class")).distinct(), "class", "left_semi")
    having = C.stored(classed(urls, needed, "url"), "url-classed")
    index = prune_rules(rules, having.select(F.col("classes").alias("tokens"))).withColumnRenamed("tokens", "needs")
    mined = (having.select("url", "classes", F.explode("classes").alias("token")).join(index, "token")
             .filter(F.size(F.array_except("needs", "classes")) == 0)
             .select("url", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("said")))
    found = mined
    if list_rules:
        listed = F.inline(F.array(*[F.struct(F.lit(h.lower()).alias("key"), F.lit(p).alias("prefix"), F.lit(h + p).alias("rule"),
                                             F.lit(v).alias("said")) for h, p, v in list_rules]))
        parts = F.split("host", r"\.")
        hosts = F.transform(F.sequence(F.lit(1), F.size(parts)),
                            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        found = found.unionByName(urls.select("url", "path", F.explode(F.array_distinct(hosts)).alias("key"))
                                  .join(F.broadcast(urls.sparkSession.range(1).select(listed)), "key")
                                  .filter(F.startswith("path", "prefix")).select("url", "rule", "said"))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("n"), (F.col("said") == "block").alias("b"), "rule", "said")))
    judged = found.groupBy("url").agg(best.alias("best"), F.bool_or(F.col("rule").isNull()).alias("mined"))
    out = rows.join(judged, "url", "left")
    mined_hit = F.coalesce("mined", F.lit(False))
    return out.select(*C.with_new(pages.columns, {
        "host": url_host(F.col("url")), "path": url_path(F.col("url")), "rule": F.col("best.rule"),
        "verdict": F.coalesce("best.said", F.when(mined_hit, F.lit("block")).otherwise(F.lit("allow"))),
        "mined": mined_hit}))
