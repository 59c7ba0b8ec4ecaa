"""Periodic runs of words, from Lyndon roots.

Method: a run's root is the longest Lyndon word at some place, under an order of
the words or under the opposite one. Both Lyndon arrays come from phase one of Baier's
suffix sorter, which groups places by ever longer Lyndon prefixes, from the greatest group
to the least; when a group's turn comes its prefix is final, and its length is the array's entry.
Each place with its Lyndon prefix as root is then extended to both sides by
longest common extensions, and what is at least two roots long is a run.

Only stretches that can hold a run are sorted: a run of ``m`` words or more (and of two periods
at least) repeats a string of ``m / 2`` words one period on, and the two copies cover it, so
every word of it lies in a string of that length that its text has twice.

Scale: no shuffle; a task holds the words of one chunk of texts. The common
extensions are found by binary search on two prefix hashes, in arrays over all
places at once, and each run is then compared word by word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks as B
from . import pieces as P
from . import texts as X

MIN_WORDS = 12
#: Modulus and bases of the prefix hashes.
MODULUS = (1 << 31) - 1
BASES = (1_000_003, 998_244_353)


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place.

    ``codes`` are the numbers 0 to the largest; 0 parts the texts (no word reaches over it,
    and its own entries mean nothing), and the end counts as less than all.
    """
    group = list(codes)
    n, symbols = len(codes), max(codes, default=0) + 1
    members: list = [[] for _ in range(symbols)]
    for i, c in enumerate(codes):
        members[c].append(i)
    size = [1] * symbols
    below, above = list(range(-1, symbols - 1)), list(range(1, symbols + 1))
    before, done = [-1] * n, bytearray(n)
    at = symbols - 1
    while at > 0:
        here = [i for i in members[at] if group[i] == at]
        members[at] = None
        for i in here:
            done[i] = 1
        # The place in a lower group before each member; how many members follow that place.
        followed: dict[int, list[int]] = {}
        last, count = -1, 0
        for i in here:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0 and codes[j]:
                if j == last:
                    count += 1
                    continue
                if last >= 0:
                    followed.setdefault(count, []).append(last)
                last, count = j, 1
        if last >= 0:
            followed.setdefault(count, []).append(last)
        # Those places' prefixes grow by the group's; more of them come above fewer.
        for count in sorted(followed, reverse=True):
            fresh: dict[int, int] = {}
            for j in followed[count]:
                old = group[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(size)
                    size.append(size[old] + count * size[at])
                    members.append([])
                    upper = above[old]
                    above.append(upper)
                    below.append(old)
                    above[old] = below[upper] = new
                group[j] = new
                members[new].append(j)
        at = below[at]
    return [size[g] for g in group]


class Extensions:
    """Longest common extensions of places of ``x``, forwards and backwards."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        value = B.draw(x.astype(np.int64).view(np.uint64), 1) % np.uint64(MODULUS)
        self.powers, self.sums = [], []
        for base in BASES:
            power = np.ones(n + 1, np.uint64)
            have, step = 1, base
            while have <= n:
                more = min(have, n + 1 - have)
                power[have:have + more] = power[:more] * np.uint64(step) % np.uint64(MODULUS)
                have, step = have + more, step * step % MODULUS
            self.powers.append(power)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(value * power[:n] % np.uint64(MODULUS), dtype=np.uint64)]))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings of ``size`` at a < b are equal."""
        ok = np.ones(len(a), bool)
        m = np.uint64(MODULUS)
        for power, total in zip(self.powers, self.sums, strict=True):
            ok &= (total[a + size] - total[a]) % m * power[b - a] % m == (total[b + size] - total[b]) % m
        return ok

    def reach(self, i: np.ndarray, p: np.ndarray, back: bool) -> np.ndarray:
        """How far places i and i + p agree: from i on, or before i."""
        low = np.zeros(len(i), np.int64)
        high = i.copy() if back else len(self.x) - i - p
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            start = i[open_] - middle if back else i[open_]
            ok = self.equal(start, start + p[open_], middle)
            low[open_] = np.where(ok, middle, low[open_])
            high[open_] = np.where(ok, high[open_], middle - 1)
        return low


def all_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods or more; 0 parts the texts."""
    x = codes.astype(np.int64)
    walls = np.flatnonzero(x == 0)
    x[walls] = -1 - np.arange(len(walls))
    extend = Extensions(x)
    top, found = int(codes.max(initial=0)), set()
    for order in (codes, np.where(codes > 0, top + 1 - codes, 0)):
        p = np.array(lyndon_lengths(order.tolist()), np.int64)
        i = np.flatnonzero((codes > 0) & (np.arange(len(x)) + p < len(x)))
        p = p[i]
        i, p = (a[(x[i] == x[i + p]) | (x[i - 1] == x[i + p - 1])] for a in (i, p))
        left, right = extend.reach(i, p, True), extend.reach(i, p, False)
        long = left + right >= p
        found.update(zip((i - left)[long].tolist(), (left + p + right)[long].tolist(), p[long].tolist(), strict=True))
    start, length, period = (np.array(a, np.int64) for a in zip(*sorted(found), strict=True)) if found else [np.zeros(0, np.int64)] * 3
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        if not np.array_equal(x[s:s + n - q], x[s + q:s + n]):
            raise ArithmeticError("two unequal strings share both prefix hashes")
    return start, length, period


def stretches(codes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the parts of the texts whose words all lie in strings of ``least`` / 2 words that their text repeats."""
    n = max((least + 1) // 2, 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = max(len(codes) - n + 1, 0)
    word = B.draw(codes.astype(np.uint64), 3)
    h = B.mix(doc[:total].astype(np.uint64), word[:total])
    for k in range(1, n):
        h = B.mix(h, word[k:total + k])
    inside = np.flatnonzero(doc[:total] == doc[n - 1:])
    by = inside[np.argsort(h[inside], kind="stable")]
    same = np.append(h[by[1:]] == h[by[:-1]], False) if len(by) else np.zeros(0, bool)
    twice = by[same | np.concatenate([[False], same[:-1]])] if len(by) else by
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    marked = np.cumsum(cover[:-1]) > 0
    first = marked.copy()
    first[1:] &= ~marked[:-1] | (doc[1:] != doc[:-1])
    last = marked.copy()
    last[:-1] &= ~marked[1:] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    return start[length >= least], length[length >= least]


def runs_of_texts(codes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of the texts' runs of ``least`` words and two periods or more, by text, start, period."""
    start, length = stretches(codes, sizes, least)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    place = X.ragged(start - 1, length + 1)  # a wall stands before each stretch
    wall = np.cumsum(length + 1) - length - 1
    place[wall] = 0
    dense = np.unique(codes[place], return_inverse=True)[1] + 1
    dense[wall] = 0
    s, n, p = all_runs(dense)
    s, n, p = (a[n >= least] for a in (s, n, p))
    s = place[s]
    first = np.cumsum(sizes) - sizes
    doc = np.searchsorted(first + sizes, s, "right")
    by = np.lexsort([p, s])
    return doc[by], (s - first[doc])[by], n[by], p[by]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = MIN_WORDS) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed`` of each text.

    A run is a stretch of words with smallest period q, of two periods and ``min_words`` words at least, that no
    neighbouring word extends. ``collapsed`` is the text without the words that some run has after its first q, joined by one space.

    * words lie between the six ASCII white space characters and are compared as they are.
    * null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    * repeated rows come back one by one; an empty table gives an empty table; a kept column
      named like a new one is left out. Ties do not arise: two runs differ in start or period.
    * a very long text is a chunk of its own; the work is linear but for a logarithm.
    """
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)),
                        T.StructField("collapsed", T.StringType())])

    def make():
        def work(texts: list) -> list:
            found = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            codes = P.numbered([w for f in found for w in f])[1]
            doc, start, length, period = runs_of_texts(codes, sizes, min_words)
            first = np.cumsum(sizes) - sizes
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, first[doc] + start + period, 1)
            np.add.at(cover, first[doc] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            with_runs = set(doc.tolist())
            out = []
            for i, words in enumerate(found):
                if i in with_runs:
                    words = [words[k] for k in np.flatnonzero(kept[first[i]:first[i] + sizes[i]]).tolist()]
                out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            runs = pa.StructArray.from_arrays([pa.array(a) for a in (start, length, period)], names=_RUN.fieldNames())
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(found)))]).astype(np.int32)
            return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(out, pa.string())]

        return work

    return X.map_texts(docs, text, keep, new, make)
