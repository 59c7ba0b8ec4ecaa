"""Token counts by dynamic programming over a trie of pre-tokens.

Method: the distinct pre-tokens of a chunk of texts are put in order and read
as a trie, level by level. A node's forward score is the best sum of piece
scores over its prefix (unigram segmentation); it is computed once, from the
nodes above it, for all pre-tokens that share the prefix. The number of pieces
on the best path is stored where a pre-token ends, and a text's count is the
sum over its pre-tokens. Piece look-ups use 64-bit prefix hashes.

Scale: texts are counted where they are read, with no shuffle; memory is
bounded by the chunk, except for a single longer text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces as P
from . import texts as X

#: Longer pre-tokens (mostly unbroken junk) are scored one by one, not as deep tries.
TRIE_DEPTH = 64
BASE = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Hash table from (64-bit hash) to the piece; rows that clash are probed on."""

    def __init__(self, pieces: P.Pieces):
        found = [(t, s) for t, s in zip(pieces.text, pieces.score, strict=True) if t]
        self.most = max((len(t) for t, _ in found), default=1)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.most, BASE)]))
        self.bits = max(4, int(np.ceil(np.log2(len(found) * 8 + 1))))
        size = 1 << self.bits
        self.keys, self.scores = np.zeros(size, np.uint64), np.full(size, -np.inf)
        self.probes = 1
        for t, s in found:
            h = np.array([self.hash(P.code_points(t))], np.uint64)
            at, tries = int(self.place(h)[0]), 1
            while self.scores[at] != -np.inf:
                at, tries = (at + 1) % size, tries + 1
            self.keys[at], self.scores[at] = h[0], s
            self.probes = max(self.probes, tries)
        self.unk = min((s for _, s in found), default=0.0) - P.UNK_PENALTY

    def hash(self, codes: np.ndarray) -> int:
        out = 0
        for c in codes.tolist():
            out = (out * int(BASE) + c + 1) & (1 << 64) - 1
        return out

    def place(self, h):
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Score of the piece with each hash, -inf without one."""
        at = self.place(h).astype(np.int64)
        hit = self.keys[at] == h
        out = np.where(hit, self.scores[at], -np.inf)
        for step in range(1, self.probes):
            rest = np.flatnonzero(~hit)
            there = (at[rest] + step) & (len(self.keys) - 1)
            ok = self.keys[there] == h[rest]
            out[rest[ok]] = self.scores[there[ok]]
            hit[rest[ok]] = True
        return out


def trie_counts(units: list[str], look: Lookup, fallback: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of the best path of each of the distinct ``units``, which are in order."""
    n, size = len(units), np.fromiter(map(len, units), np.int64, len(units))
    codes, first = P.code_points("".join(units)).astype(np.uint64), np.cumsum(size) - size
    count, total = np.zeros(n, np.int64), np.zeros(n)
    node, hashes = [np.zeros(n, np.int64)], [np.zeros(n, np.uint64)]
    best, used = [np.zeros(1)], [np.zeros(1, np.int64)]
    live = np.arange(n)
    for depth in range(1, int(size.max(initial=0)) + 1):
        live = live[size[live] >= depth]
        char = codes[first[live] + depth - 1]
        up = node[-1][live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (up[1:] != up[:-1]) | (char[1:] != char[:-1])
        here = np.zeros(n, np.int64)
        here[live] = np.cumsum(fresh) - 1
        h = np.zeros(n, np.uint64)
        h[live] = hashes[-1][live] * BASE + char + np.uint64(1)
        lead, last = live[fresh], char[fresh]
        # The oldest start first and a strict comparison: of equal paths the longer last piece stays.
        score, steps = np.full(len(lead), -np.inf), np.zeros(len(lead), np.int64)
        for length in range(min(depth, look.most), 0, -1):
            above = node[-length][lead]
            got = look.find(h[lead] - hashes[-length][lead] * look.power[length])
            more = np.ones(len(lead), np.int64)
            if length == 1:
                lost = got == -np.inf
                got[lost] = look.unk
                if fallback:
                    more[lost] = 1 + (last[lost] > 0x7F) + (last[lost] > 0x7FF) + (last[lost] > 0xFFFF)
            got = got + best[-length][above]
            better = got > score
            score[better] = got[better]
            steps[better] = (used[-length][above] + more)[better]
        for past, now in ((node, here), (hashes, h), (best, score), (used, steps)):
            past.append(now)
            del past[:-look.most]
        ends = live[size[live] == depth]
        count[ends], total[ends] = steps[here[ends]], score[here[ends]]
    return count, total


def path_counts(unit: str, pieces: dict[str, float], look: Lookup, fallback: bool) -> tuple[int, float]:
    """The same for one pre-token of any length."""
    best, used = [0.0], [0]
    for end in range(1, len(unit) + 1):
        score, steps = -np.inf, 0
        for start in range(max(0, end - look.most), end):
            s = pieces.get(unit[start:end])
            more = 1
            if s is None:
                if start < end - 1:
                    continue
                s, more = look.unk, len(unit[start].encode()) if fallback else 1
            if best[start] + s > score:
                score, steps = best[start] + s, used[start] + more
        best.append(score)
        used.append(steps)
    return used[-1], best[-1]


def count_tokens(docs: DataFrame, model: P.Pieces, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (default: all) plus n_units, n_distinct (of the text), n_tokens (long), score (double).

    * null or empty text: no units, no tokens, score 0.
    * characters that no piece has count as their UTF-8 bytes if the
      vocabulary has byte pieces, else as one unknown token.
    * equal scores: the path whose last piece is longer.
    * repeated rows are counted alike; an empty table gives an empty table;
      kept columns named like the new ones are replaced.
    """
    new = T.StructType([T.StructField(c, T.LongType()) for c in ("n_units", "n_distinct", "n_tokens")]
                       + [T.StructField("score", T.DoubleType())])

    def make():
        pattern, look = re.compile(model.unit_pattern(), re.S), Lookup(model)
        table = {t: s for t, s in zip(model.text, model.score, strict=True) if t}

        def work(batch: list) -> list[pa.Array]:
            units, places, counts = P.split(batch, pattern)
            order = sorted(range(len(units)), key=units.__getitem__)
            short = [i for i in order if len(units[i]) <= TRIE_DEPTH]
            tokens, scores = np.zeros(len(units), np.int64), np.zeros(len(units))
            tokens[short], scores[short] = trie_counts([units[i] for i in short], look, model.fallback)
            for i, u in enumerate(units):
                if len(u) > TRIE_DEPTH:
                    tokens[i], scores[i] = path_counts(u, table, look, model.fallback)
            owner = np.repeat(np.arange(len(batch)), counts)
            distinct = np.bincount(np.unique(owner * max(len(units), 1) + places) // max(len(units), 1), minlength=len(batch))
            return [pa.array(counts), pa.array(distinct.astype(np.int64)), pa.array(X.sums(tokens[places], counts)),
                    pa.array(np.bincount(owner, scores[places], len(batch)))]

        return work

    return X.map_texts(docs, text, docs.columns if keep is None else keep, new, make)
