"""Benchmark decontamination by template windows.

Method: numbers, units next to them and capitalised words of documents and
items become typed placeholders. Windows of ``WINDOW`` template tokens are
hashed and joined by hash. So are the windows of the tokens as they are, in lower case; they
find verbatim copies whatever their slots and capitals are. Windows that line up (same document, item and
shift) are put together position by position; what stands in the item's slots
is mapped to what stands in the document's, and slots that disagree do not count.
So an item is found as it is, and with other numbers, units or names.

Scale: the items' window hashes are counted first. Up to ``max_broadcast`` of
them (8 bytes each) go to the tasks, which then emit only windows that some
item has; beyond that every window is emitted and the join alone decides, with
the same result. Nothing is grouped but by document, item and shift.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import pieces as P
from . import texts as X

WINDOW = 8
#: An item of fewer tokens than ``WINDOW`` is one window of its own length; below this it cannot be told from chance.
SHORTEST = 5
#: Tokens of an item (or all, if it has fewer) that a document must have in line.
MIN_TOKENS = 13
#: Words and signs that are units next to a number.
UNITS = frozenset("""
% $ € £ ° percent cent cents dollar dollars euro euros pound pounds usd eur gbp
mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces lb lbs
ml l liter liters litre litres gallon gallons cup cups
s ms sec min h hr second seconds minute minutes hour hours day days week weeks month months year years
""".split())
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]")
_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x, seed=1)) for x in ("number", "unit", "name"))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def canonical(texts: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, token of each place, its template hash, its own hash, whether it is a slot, tokens of each text."""
    found = [TOKEN.findall(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    tokens, places = P.numbered([x for f in found for x in f])
    number = np.array([x[0].isdigit() for x in tokens], bool)[places]
    unit = np.array([x.lower() in UNITS for x in tokens], bool)[places]
    name = np.array([x[0].isupper() for x in tokens], bool)[places]
    literal = np.array([xxhash.xxh64_intdigest(x.lower()) for x in tokens], np.uint64)[places]
    first = np.zeros(len(places) + 1, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    before, after = np.zeros(len(places), bool), np.zeros(len(places), bool)
    if len(places):
        before[1:] = number[:-1] & ~first[1:-1]
        after[:-1] = number[1:] & ~first[1:-1]
    signs = np.array([not x[0].isalnum() for x in tokens], bool)[places]
    unit = unit & (before | (after & signs))
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, literal)))
    return tokens, places, template, literal, number | unit | name, counts


def window_hashes(template: np.ndarray, slot: np.ndarray | None, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``n`` tokens starts, and the windows' hashes.

    With ``slot``, half of a window's tokens are literal at least; without, all are taken as they are.
    """
    total = len(template) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(total, np.uint64(n if slot is not None else n + 1000))
    slots = np.zeros(total, np.int64)
    for i in range(n):
        h = h * _BASE + (template[i:total + i] ^ template[i:total + i] >> np.uint64(31))
        if slot is not None:
            slots += slot[i:total + i]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(template))
    at = np.flatnonzero((left[:total] >= n) & (2 * slots <= n))
    return at, h[at].view(np.int64)


_WINDOWS = T.StructType([T.StructField("w", T.LongType()), T.StructField("pos", T.LongType()),
                         T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("slots", T.ArrayType(T.BooleanType()))])


def windows(df: DataFrame, keep: list[str], text: str, lengths: list[int], only: np.ndarray | None,
            own_length: bool = False) -> DataFrame:
    """``keep`` plus a row for each window: hash ``w``, position ``pos``, ``tokens`` (lower case), ``slots``.

    ``only``: sorted hashes to which the windows are limited. ``own_length``:
    items, for which a window is ``WINDOW`` tokens, or all of a shorter item, and
    ``n_tokens`` is added.
    """
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    fields = [*_WINDOWS.fields, *([T.StructField("n_tokens", T.LongType())] if own_length else [])]
    schema = T.StructType(source.schema.fields[:-1] + fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if only is not None:
            seen = np.zeros(1 << 20, bool)
            seen[only & (1 << 20) - 1] = True
        for batch in batches:
            for part in X.chunks(batch, len(keep)):
                tokens, places, template, literal, slot, counts = canonical(part.column(len(keep)).to_pylist())
                lower = np.array([x.lower() for x in tokens], object)
                ends = np.cumsum(counts)
                for n, values, flags in [(n, *x) for n in lengths for x in ((template, slot), (literal, None))]:
                    at, h = window_hashes(values, flags, counts, n)
                    row = np.searchsorted(ends, at, "right")
                    if own_length:
                        ok = (counts[row] == n) | ((n == WINDOW) & (counts[row] > n))
                    elif only is not None:
                        ok = seen[h & (1 << 20) - 1]
                        ok[ok] = only[np.minimum(np.searchsorted(only, h[ok]), len(only) - 1)] == h[ok]
                    else:
                        ok = np.ones(len(at), bool)
                    at, h, row = at[ok], h[ok], row[ok]
                    for a in range(0, len(at), 100_000):
                        here, r = at[a:a + 100_000], row[a:a + 100_000]
                        inner = X.ragged(here, np.full(len(here), n))
                        size = np.full(len(here), n)
                        out = [*[c.take(pa.array(r)) for c in part.columns[:-1]], pa.array(h[a:a + 100_000]),
                               pa.array(here - (ends - counts)[r]),
                               X.list_array(lower[places[inner]], size, pa.string()),
                               X.list_array(slot[inner], size, pa.bool_())]
                        yield pa.RecordBatch.from_arrays(out + ([pa.array(counts[r])] if own_length else []), names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def judge(tokens: list[tuple[int, str, str, bool]], need: int) -> tuple[int, int, int] | None:
    """Tokens found in line, slots, and slots with another value, or None if the line is no leak.

    ``tokens``: (place, item's token, document's token, slot). An item's value stands for the document's
    value that it meets most often; other slots of it do not count, nor do changed ones whose new
    value stands unchanged elsewhere. Two values that became one are a leak only
    beside ``need`` equal tokens on end.
    """
    tokens = sorted(set(tokens))
    votes: dict[str, Counter] = defaultdict(Counter)
    for _, i, d, slot in tokens:
        if slot:
            votes[i][d] += 1
    stands = {i: min(v, key=lambda d: (-v[d], d != i, d)) for i, v in votes.items()}
    same = {i for i, d in stands.items() if i == d}
    changed = {i: d for i, d in stands.items() if i != d and d not in same}
    found = {at for at, i, d, slot in tokens if i == d or (slot and changed.get(i) == d)}
    if len(found) < need:
        return None
    if len(set(changed.values())) < len(changed):
        longest = run = 0
        last = None
        for at in sorted({at for at, i, d, _ in tokens if i == d}):
            run = run + 1 if last is not None and at == last + 1 else 1
            longest, last = max(longest, run), at
        if longest < need:
            return None
    return len(found), len({t[0] for t in tokens if t[3]}), sum(t[3] and t[1] != t[2] for t in tokens)


def judged(lines: DataFrame) -> DataFrame:
    """The lines that are leaks, with ``found``, ``n_slots`` and ``n_changed``; a line is no longer than its item."""
    keep = [c for c in lines.columns if c != "x"]
    new = ["found", "n_slots", "n_changed"]
    schema = T.StructType([*lines.select(*keep).schema.fields, *[T.StructField(c, T.LongType()) for c in new]])
    size = keep.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge([(x["at"], x["i"], x["d"], x["slot"]) for x in xs], min(MIN_TOKENS, n))
                   for xs, n in zip(batch.column(len(keep)).to_pylist(), batch.column(size).to_pylist(), strict=True)]
            ok = pa.array([g is not None for g in got], pa.bool_())
            rows = [g for g in got if g is not None]
            yield pa.RecordBatch.from_arrays([*[c.filter(ok) for c in batch.columns[:-1]],
                                              *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]], names=keep + new)

    return lines.select(*keep, "x").mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
               item_text: str = "text", max_broadcast: int = 4_000_000) -> DataFrame:
    """One row for each document (its key ``rk1, rk2`` and ``doc_id``) and item (``item_id``) that it holds.

    Also ``pos`` (token where the item would begin), ``n_tokens`` found in line, ``item_tokens``,
    ``n_slots``, ``n_changed`` (slots with another value). The best line of each pair is
    given: most tokens, then fewest changes, then first.

    * null or empty texts and items have no windows; items under ``SHORTEST`` tokens find nothing.
    * repeated rows (same id and text) are one document, repeated items (same id and text) one item.
    * an empty table on either side gives an empty result; extra columns are not looked at.
    """
    lengths = list(range(SHORTEST, WINDOW + 1))
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).distinct()
    index = C.stored(windows(named, ["item_id"], "t", lengths, None, own_length=True), "items")
    hashes = index.select("w").distinct()
    only = None
    if (n := hashes.count()) <= max_broadcast:
        only = np.sort(np.array([r["w"] for r in hashes.collect()], np.int64))
    if n == 0:
        only = np.array([0], np.int64)
    used = sorted({r["n"] for r in index.select(F.size("tokens").alias("n")).distinct().collect()}) or [WINDOW]
    keyed = docs.select(*C.row_key(F.col(id_col), F.col(text)), F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    theirs = windows(keyed, ["rk1", "rk2", "doc_id"], "t", used, only)
    mine = index.select("w", "item_id", F.col("pos").alias("ipos"), F.col("tokens").alias("itokens"), "slots", "n_tokens")
    pairs = theirs.drop("slots").join(mine, "w")
    line = ["rk1", "rk2", "doc_id", "item_id", "n_tokens", "pos"]
    each = pairs.select("rk1", "rk2", "doc_id", "item_id", "n_tokens", (F.col("pos") - F.col("ipos")).alias("pos"),
                        F.explode(F.zip_with(F.arrays_zip("tokens", "itokens", "slots"), F.sequence(F.lit(0), F.size("tokens") - 1),
                                             lambda x, i: F.struct((F.col("ipos") + i).alias("at"), x["tokens"].alias("d"),
                                                                   x["itokens"].alias("i"), x["slots"].alias("slot")))).alias("x"))
    each = each.select(*line, "x.*").distinct()
    lines = each.groupBy(*line).agg(F.collect_list(F.struct("at", "i", "d", "slot")).alias("x")).filter(
        F.size("x") >= F.least(F.lit(MIN_TOKENS), F.col("n_tokens")))
    good = judged(lines)
    best = good.groupBy("rk1", "rk2", "doc_id", "item_id").agg(F.min(F.struct(
        (-F.col("found")).alias("f"), "n_changed", "pos", F.col("n_tokens").alias("item_tokens"), "n_slots")).alias("b"))
    return best.select("rk1", "rk2", "doc_id", "item_id", "b.pos", (-F.col("b.f")).alias("n_tokens"), "b.item_tokens",
                       "b.n_slots", "b.n_changed")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are."""
    found = find_leaks(docs, items, id_col, text, **settings).select("rk1", "rk2").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *C.row_key(F.col(id_col), F.col(text)))
    return rows.join(found, ["rk1", "rk2"], "left_anti").select("row.*")
