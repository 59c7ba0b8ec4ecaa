"""Turn repair and periodic runs against brute force."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazrank.llm import conversation_repair as R
from gazrank.llm import periodic_runs as P
from gazrank.llm import queries as Q

RNG = random.Random(11)
SPACES = " \t\n\x0b\x0c\r"


def brute_lyndon(x):
    return [next(k for k in range(1, len(x) - i + 1) if x[i + k:] < x[i:]) for i in range(len(x))]


def brute_runs(w, least):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q):
                part = w[i:i + n]
                if all(part[d:] != part[:-d] for d in range(1, q)):
                    found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_for_runs(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out += unit * rng.randint(1, 7) + unit[:rng.randint(0, 3)]
    return out


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 30))]
        assert P.lyndon_lengths(x) == brute_lyndon(x), x
    joined = P.lyndon_lengths([0, 1, 2, 1, 0, 2, 2, 1, 2])
    assert joined[1:4] == brute_lyndon([1, 2, 1]) and joined[5:] == brute_lyndon([2, 2, 1, 2])


def test_runs_against_brute_force():
    rng = random.Random(2)
    for least in (2, 5, 12):
        texts = [words_for_runs(rng) for _ in range(150)]
        texts += [list("abaababaabaababaababa" * 3), list("a" * 500), []]
        sizes = np.array([len(t) for t in texts])
        codes = np.array([ord(c) for t in texts for c in t], np.int64)
        doc, start, length, period = P.runs_of_texts(codes, sizes, least)
        got = {d: [] for d in range(len(texts))}
        for row in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            got[row[0]].append(row[1:])
        for d, t in enumerate(texts):
            assert got[d] == brute_runs(t, least), (least, t)


def test_long_runs():
    n = 200_000
    doc, start, length, period = P.runs_of_texts(np.zeros(n, np.int64), np.array([n]), 12)
    assert list(zip(start, length, period, strict=True)) == [(0, n, 1)]


@pytest.fixture(scope="module")
def run_docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words_for_runs(rng)) + rng.choice(["", "\n", " é x"]), i) for i in range(120)]
    rows += [(200, None, 1), (201, "", 1), (202, " \t\n", 1), (7, rows[7][1], 7), (None, "x " * 15, 1), (300, "y " * 30_000, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(3)


def test_runs_of_documents(run_docs):
    got = P.find_runs(run_docs, keep=["doc_id", "text", "runs"]).collect()
    assert len(got) == run_docs.count()
    for r in got:
        w = (r.text or "").encode().split()
        runs = [tuple(x) for x in r.runs]
        if len(w) < 1000:
            assert runs == brute_runs(w, 12)
        else:
            assert runs == [(0, len(w), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.n_words == len(w) and r.collapsed == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    assert P.find_runs(run_docs.limit(0)).count() == 0


def test_op13_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ab", "c", "Dé"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 150)))) for i in range(300)]
    rows += [(1000, None), (None, "a b"), (45, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id != 45 or r.n_runs == 0}
    planted = 0
    for i, t in rows[:300]:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        runs = brute_runs(w, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 10 and sum(r.n_runs > 0 for r in got.values()) > 5
    assert got[1000].n_runs == 0 and got[1000].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def brute_repair(rows):
    """Cheapest edits (ASCII-least) of rows (role, text) in order: faults, cost, audit, lines."""
    seen, faults = set(), []
    for role, text in rows:
        last = text.strip(SPACES)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            c, s, lines = best(i, turn[state], inserts + 1)
            options.append((c + 2, "I" + s, (name[turn[state]] + ":", *lines)))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            c, s, lines = best(i + 1, state, 0)
            options.append((c + 3, "D" + s, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                c, s, lines = best(i + 1, turn[state], 0)
                options.append((c + 2 + extra, "R" + s, (f"{name[turn[state]]}:{text}", *lines)))
                if role[:1] in after[state]:
                    c, s, lines = best(i + 1, after[state][role[:1]], 0)
                    options.append((c + extra, "K" + s, (f"{role}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    legal = {"su", "ua", "au"}
    illegal = sum(a[0][:1] + b[0][:1] not in legal for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = best(0, "", 0)
    return [faults.count(x) for x in ("blank", "duplicate", "truncated")] + [illegal, cost], audit, lines


def some_turns(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    texts = ["Hi.", "Yes", "No!", " \n", "", None, "Why? ", "Ok.\t", "é."]
    return [(rng.choice([None, k, k, k, k + rng.randint(0, 2)]) if rng.random() < 0.3 else k, rng.choice(roles[:3] * 4 + roles), rng.choice(texts))
            for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, R.BLOCK])
def test_repair_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(R.backpointers, "__defaults__", (block,))
    rng = random.Random(5)
    convs = {c: some_turns(rng, rng.randint(1, 9)) for c in [*range(150), None]}
    convs[500] = [(k, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 40)}.") for k in range(120)]
    rows = [(c, t, r, x, "other") for c, turns in convs.items() for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(5)
    got = {r.conv_id: r for r in R.report(df).collect()}
    fixed = {}
    for r in R.repair(df).orderBy("conv_id", "pos").collect():
        fixed.setdefault(r.conv_id, []).append(r)
    order = {(r.conv_id, r.turn, r.role, r.text): (r.h1, r.h2) for r in df.select(
        "conv_id", "turn", "role", "text", *R.C.row_key(F.coalesce("text", F.lit(" ")))).toDF(
        "conv_id", "turn", "role", "text", "h1", "h2").collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        ordered = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] if x[1] is not None else " ").encode(), order[c, *x]))
        plain = [(" " if r is None else r, " " if x is None else x) for _, r, x in ordered]
        counts, audit, lines = brute_repair(plain)
        r = got[c]
        assert [r.blank, r.duplicate, r.truncated, r.illegal, r.cost] == counts, (c, plain)
        assert r.audit == audit and r.n_rows == len(turns)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        numbers = [t for t, _, _ in turns if t is not None]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [f"{x.role}:{x.text}" for x in fixed.get(c, [])] == list(lines)
        assert [x.pos for x in fixed.get(c, [])] == list(range(len(lines)))
        assert "".join(x.edit for x in fixed.get(c, [])) == audit.replace("D", "")
    assert R.report(df.limit(0)).count() == 0 and R.repair(df.limit(0)).count() == 0


def test_op12_query(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for c in [*range(200), None]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t if rng.random() > 0.05 else None, "system" if not t and c and c % 3 == 0 else ("user", "assistant")[t % 2],
                         rng.choice(["Hi there.", "So it is!", "Hm?", "x", None]) if rng.random() < 0.5 else f"Text {t} of {c}."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in Q.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    text = lambda v: " " if v is None else str(v)
    hashes = {(r.t): (r.a, r.b) for r in df.select(F.coalesce("text", F.lit(" ")).alias("t")).unionByName(
        df.select(F.translate("text", ".!?", "").alias("t"))).unionByName(df.limit(1).select(F.lit("").alias("t"))).distinct().select(
        "t", *R.C.row_key(F.col("t"))).toDF("t", "a", "b").collect()}
    empty = 0
    for c in got:
        left = []
        for _, t, role, words in [r for r in rows if r[0] == c]:
            way, role, words = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20, text(role), text(words)
            if way == 0:
                continue
            words = "" if way == 1 else words.translate(dict.fromkeys(map(ord, ".!?"))) if way == 2 else words
            left += [(t, "user" if way == 4 else role, words)] * (2 if way == 3 else 1)
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashes[x[2]]))
        counts, audit, lines = brute_repair([x[1:] for x in left])
        r = got[c]
        assert [r.blank, r.duplicate, r.truncated, r.illegal, r.cost] == counts and r.audit == audit
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        empty += not left
    assert empty
