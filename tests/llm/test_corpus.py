"""Corpus-wide operators against brute force: language model, near copies, passages, components, pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gazrank.llm import blocks as B
from gazrank.llm import components as K
from gazrank.llm import lm_scoring as L
from gazrank.llm import near_dup as N
from gazrank.llm import substring_dedup as S

RNG = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_packing():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (B.unpack_sorted(B.pack_sorted(a)) == a).all()
    assert len(B.unpack(B.pack(np.zeros(0, np.uint32)), np.uint32)) == 0


@pytest.fixture(scope="module")
def lm_docs(spark):
    words = ["the", "a", "Cat", "dog", "sat", "ran", "on", "mat"]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 7]) for _ in range(rng.randint(1, 40))), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "unseen words only é", "x"), (5, rows[5][1], "x"), (None, "the cat", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


def test_lm_counts_base_and_mixture(lm_docs):
    rows = [(r.doc_id, r.text) for r in lm_docs.collect()]
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10

    def counted(keep):
        one, two = Counter(), Counter()
        for i, t in rows:
            if keep(fold(i)):
                w = tokens(t)
                one.update(w)
                two.update(zip(["<s>", *w], w))
        one["<s>"] = one[None]
        return one, two

    def parts(one, two, w):
        n, v = sum(c for k, c in one.items() if k != "<s>"), len([k for k in one if k != "<s>" and one[k]])
        for p, x in zip(["<s>", *w], w):
            c = one[p]
            yield (math.floor(math.log2(c)) + 1 if c else 0, two[p, x] / c if c else 0.0, one[x] / n, 1 / (v + 1))

    rest, tune = counted(lambda f: 1 <= f <= 8), [w for i, t in rows if fold(i) == 9 for w in [tokens(t)]]
    cells = Counter()
    for w in tune:
        for b, two, one, uni in parts(*rest, w):
            step = lambda p: round(math.log(p / uni) / L.STEP) if p else L._NONE
            cells[b, step(two), step(one)] += 1
    weights = L.learn(np.array([(*k, n) for k, n in sorted(cells.items())], float))
    train = counted(lambda f: f >= 1)
    n = sum(c for k, c in train[0].items() if k != "<s>")
    v = len([k for k in train[0] if k != "<s>"])
    got = L.score_texts(lm_docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        w, r = tokens(t), by[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 0, len(w), sum(train[0][x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        score = 0.0
        for b, two, one, uni in parts(*train, w):
            p = weights.get(b, weights[-1])
            score += math.log10(p[0] * two + p[1] * one + p[2] * uni if b else (p[1] + p[0] / 2) * one + (p[2] + p[0] / 2) * uni)
        assert r.score == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert L.score_texts(lm_docs.limit(0)).count() == 0


def test_em_finds_the_best_mixture():
    rows = [(1, 60, 20, 7000), (1, L._NONE, 20, 3000)]
    w = L.learn(np.array(rows, float))[1]
    two, one = math.exp(60 * L.STEP), math.exp(20 * L.STEP)
    # Derivative of 0.7 log(two x + one (1 - x)) + 0.3 log(one (1 - x)) is 0.
    best = (0.7 * (two - one) - 0.3 * one) / (two - one)
    assert w[0] == pytest.approx(best, abs=0.01) and w.sum() == pytest.approx(1)


def edited(text, k, rng):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def dup_rows():
    rng = random.Random(11)
    base = prose(200, rng)
    rows = [prose(rng.randint(30, 120), rng) for _ in range(60)]
    rows += [base] + [edited(base, rng.randint(1, 5), rng) for _ in range(40)] + [base.upper().replace("W", "w") + "  "] * 3
    rows += [None, "", " \n", "a b", "A  b", "a c", "x", "hello " * 30000, "hello " * 30001]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)]


def weighted_sets(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = Counter([tuple(w[j:j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))
    df = Counter(s for c in sets.values() for s in c)
    n = len(rows)
    return {i: {s: tf * (math.log((1 + n) / (1 + df[s])) + 1) for s, tf in c.items()} for i, c in sets.items()}


def test_near_duplicates_against_all_pairs(spark, dup_rows):
    weights = weighted_sets(dup_rows)
    ids, root = [i for i, _ in dup_rows], {i: i for i, _ in dup_rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in ids:
        for y in ids[:x]:
            a, b = weights[x], weights[y]
            both = sum(min(v, b.get(s, 0.0)) for s, v in a.items())
            if (not a and not b) or both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) - 1e-9 and both:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame([(i, t, "z") for i, t in dup_rows], "doc_id long, text string, node string").repartition(4)
    got = N.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in ids}
    assert {r.doc_id for r in got if r.leads} == {find(i) for i in ids}
    kept = N.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
    assert N.classes(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    t = prose(40)
    docs = spark.createDataFrame([(None, t), (7, t), (7, t), (None, "q " * 9)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.class_id or -1) for r in N.classes(docs).collect()) == [(False, 7), (False, 7), (True, -1), (True, 7)]
    assert N.drop_copies(docs).count() == 2


def test_samples_agree_with_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    h.sort()
    w1, w2 = rng.random(300) + 0.1, rng.random(300) + 0.1
    agree = (N.samples(h, w1, np.array([0]), 3000) == N.samples(h, w2, np.array([0]), 3000)).mean()
    assert agree == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.03)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (1, 2), (1, 2)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_compact_windows_cover_every_run():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 40, 300).astype(np.uint64)
    first, size = np.array([0, 120, 125]), np.array([120, 5, 175])
    start, end, at = S.compact_windows(values, first, size, 10)
    for f, n in zip(first.tolist(), size.tolist()):
        for i in range(f, f + n):
            for j in range(i + 10, f + n + 1):
                low = values[i:j].min()
                fits = [k for k in range(len(start)) if start[k] <= i and j <= end[k] and values[at[k]] == low and low == values[start[k]:end[k]].min()]
                assert fits  # some window holds the run and has its minimum


def test_repeated_passages(spark):
    rng = random.Random(21)
    long, short = prose(60, rng), prose(30, rng)
    near = edited(long, 1, rng)
    rows = [prose(100, rng) + " " + long + " " + prose(50, rng), long.upper().replace("W", "w") + "\n" + prose(80, rng),
            prose(20, rng) + " " + near, short + " " + prose(90, rng), prose(70, rng) + " " + short, prose(300, rng)]
    rows += [prose(51, rng)] * 2 + [prose(20, rng)] * 2 + [None, "", "x " * 20000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: r for r in S.repeated_passages(docs).collect()}
    assert set(got) == {0, 1, 2, 6, 7}
    assert got[0].first_word <= 100 and got[0].end_word >= 160 and got[0].other_id in (1, 2)
    assert (got[6].first_word, got[6].end_word, got[6].other_id, got[7].other_id) == (0, 51, 7, 6)
    assert S.repeated_passages(docs.limit(0)).count() == 0


def test_every_place_of_a_passage(spark):
    rng = random.Random(22)
    long, line = prose(60, rng), prose(12, rng)
    late = line + " " + prose(43, rng)
    rows = [prose(100, rng) + " " + long + " " + prose(50, rng), prose(30, rng) + " " + long + " " + prose(70, rng) + " " + long,
            prose(20, rng) + " " + late, line + " " + prose(60, rng) + " " + late + " " + prose(9, rng)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted((r.doc_id, r.first_word, r.end_word, r.other_id) for r in S.repeated_passages(docs).collect())
    assert got == [(0, 100, 160, 1), (1, 30, 90, 0), (1, 160, 220, 0), (2, 20, 75, 3), (3, 72, 127, 2)]


def test_passages_beside_common_lines(spark, monkeypatch):
    # Either line is common, so that the groups' first texts hold one line only.
    rng = random.Random(23)
    want, rows = set(), []
    for _ in range(12):
        lines = [prose(30, rng), prose(30, rng)]
        want |= {len(rows), len(rows) + 1}
        rows += [" ".join([prose(20, rng), *lines, prose(20, rng)]) for _ in range(2)]
        rows += [" ".join([prose(40, rng), line, prose(40, rng)]) for line in lines for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in S.repeated_passages(docs).collect()} == want
    monkeypatch.setattr(S, "FEW", 0)  # every group counts as large
    assert {r.doc_id for r in S.repeated_passages(docs).collect()} == want


def test_passages_near_the_threshold(spark):
    rng = random.Random(24)
    rows = []
    for _ in range(150):
        words = prose(55, rng).split()
        rows.append(" ".join([prose(30, rng), *words, prose(30, rng)]))
        words[27] = "changed"
        rows.append(" ".join([prose(25, rng), *words, prose(35, rng)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.repeated_passages(docs).collect()}
    assert set(got) == set(range(300)) and all(0.8 <= r.similarity < 1 for r in got.values())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids < {r.doc_id for r in docs.collect()} and len(ids) == out.count()
    leaked = {r.doc_id for r in docs.join(spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("text", "item"),
                                          F.contains("text", "item")).collect()}
    assert leaked and not leaked & ids
    copies = docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).filter(F.size("ids") > 1).collect()
    assert copies and all(len(ids & set(r.ids)) <= 1 for r in copies)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "sentencepiece"]
