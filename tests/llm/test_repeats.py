"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gazrank.llm import queries as Q
from gazrank.llm import repeated_bytes as R


def brute(texts, length):
    """(n_removed, n_spans, kept) of each text, by counting all its strings."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_transform_against_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(150):
        texts = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 7))]
        cap = rng.choice([3, 200, 300])
        bwt, lcp = R.transform(np.array([x for t in texts for x in t], np.uint8), np.array([len(t) for t in texts]), cap)
        suffixes = sorted((t[i:] + [d - 1000], d, i) for d, t in enumerate(texts) for i in range(len(t) + 1))
        assert bwt.tolist() == [texts[d][i - 1] if i else 0 for _, d, i in suffixes]
        common = [0]
        for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:]):
            k = 0
            while a[k] == b[k]:
                k += 1
            common.append(min(k, cap))
        assert lcp.tolist() == common


def test_pieces_hold_every_window_once():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 5, 19, 20, 21, 90]))) for _ in range(60)] + [b"a" * 500]
    sizes = np.array([len(t) for t in texts])
    for k in R.gram_sizes(20):
        doc, first, n, anchor, key = R.cut(np.frombuffer(b"".join(texts), np.uint8), sizes, 20, k)
        windows = [(d, f + i) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist()) for i in range(m)]
        assert sorted(windows) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 19)]
        assert n.max() <= 20 - k + 1
        of = {}
        for d, f, m, a, p in zip(doc.tolist(), first.tolist(), n.tolist(), anchor.tolist(), key.tolist()):
            for i in range(m):
                assert of.setdefault(texts[d][f + i:f + i + 20], a) == a
            assert of.setdefault((a, p), texts[d][f:f + m + 19]) == texts[d][f:f + m + 19]


def corpus(rng, length):
    word = lambda: rng.choice(["ab", "é", "xyz", "q", " ", "\n"])
    prose = lambda n: "".join(word() + str(rng.randint(0, 999)) for _ in range(n))
    shared = [prose(rng.randint(length // 4, length)) for _ in range(6)]
    texts = [prose(rng.randint(0, 60)) + (rng.choice(shared)[rng.randint(0, 9):] if rng.random() < 0.6 else "") + prose(rng.randint(0, 20))
             for _ in range(120)]
    texts += [None, "", "a" * 700, "abc" * 200, texts[3], texts[5] + "é", shared[0][:length - 1]]
    return texts


@pytest.mark.parametrize("most", [R.MOST, 3, 1])
def test_removal_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(R, "BATCH", 10)
    monkeypatch.setattr(R, "SLICE", 300)
    texts = corpus(random.Random(3), 40)
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 9), (None, texts[4], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(4)
    got = {}
    for r in R.drop_repeated_bytes(df, length=40, most=most).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = brute([r[1] for r in rows], 40)
    assert sum(map(len, got.values())) == len(rows)
    for (i, t, _), (removed, spans, kept) in zip(rows, want, strict=True):
        for r in got[i]:
            assert (sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == (removed, spans, kept), i
            assert r.n_bytes == len((t or "").encode())
    assert sum(w[0] for w in want) > 1000
    assert R.drop_repeated_bytes(df.limit(0)).count() == 0


def test_op11_query(spark, tmp_path):
    rng = random.Random(4)
    texts = corpus(rng, 200)
    texts += ["".join(rng.choice("abcdefgh") for _ in range(100_000)) for _ in range(2)]
    texts.append(texts[-1][5000:9000] + "!" + texts[-2][:60_000])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op11_repeated_bytes(spark, str(tmp_path)).collect()}
    for i, (removed, spans, kept) in enumerate(brute(texts, 200)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((texts[i] or "").encode()), removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeats_inside_one_piece(spark):
    """Texts of a short period that only overlap themselves, and the same inside of prose."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = ["a" * 41, "ab" * 21 + "a", "xyzw" * 11, "c" * 40, prose(300) + "q" * 45 + prose(300), prose(90) + "12345678" * 6 + prose(90),
             *[prose(50) + prose(1) * rng.randint(38, 60) + prose(50) for _ in range(30)],
             *[prose(rng.randint(0, 20)) + (prose(rng.randint(1, 30)) * 60)[:rng.randint(38, 90)] + prose(20) for _ in range(200)]]
    for most in (R.MOST, 1):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in R.drop_repeated_bytes(df, length=40, most=most).collect()}
        for i, (removed, spans, kept) in enumerate(brute(texts, 40)):
            assert (sum(s.stop - s.start for s in got[i].spans), len(got[i].spans), bytes(got[i].kept)) == (removed, spans, kept), (most, i)
