"""SentencePiece encoding by suffix-array matching, and decoding.

Method: the distinct units of a chunk of texts (see ``pieces.split``; no piece
reaches over a unit's ends) are joined to one indexed text. A suffix array
over its first characters is made by sorting; every piece is looked up in it by binary
search, which gives a range of occurrences, so an edge (position, length,
piece) each. The edges, put in order by position, form the lattice that is relaxed:

* unigram models: forward relaxation to the best sum of scores;
* BPE models: round by round, each unit's best-ranked edge that joins two
  neighbouring symbols (the first of equal ones) replaces them, until none is
  left. That is the rule of the BPE models, so the ids are those of the
  SentencePiece library.

Scale: texts are encoded where they are read, with no shuffle; each distinct
unit of a chunk is encoded once. Memory is bounded by the chunk (a longer
text makes its own) and the index by ``INDEX_CHARS``.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces as P
from . import texts as X

#: Characters indexed at once, and the length from which a unit is merged by its own heap.
INDEX_CHARS = 1_000_000
LONG_UNIT = 64


class Matcher:
    """Finds the pieces of several characters in an indexed text."""

    def __init__(self, model: P.Pieces):
        self.model = model
        several = [(t, i) for i, t in enumerate(model.text) if t and len(t) > 1]
        self.most = max((len(t) for t, _ in several), default=2)
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in model.long]] = np.arange(1, len(model.long) + 1)
        self.bits = max(1, len(model.long).bit_length())
        self.each = 62 // self.bits
        self.words = -(-self.most // self.each)
        self.ids = np.array([i for _, i in several], np.int64)
        self.sizes = np.array([len(t) for t, _ in several], np.int64)
        low = np.zeros((self.words * self.each, len(several)), np.int64)
        for k, (t, _) in enumerate(several):
            low[:len(t), k] = self.code[P.code_points(t)]
        inside = np.arange(len(low))[:, None] < self.sizes
        self.low, self.high = self.pack(low), self.pack(np.where(inside, low, (1 << self.bits) - 1))
        # Ranks of ids by falling score; ids of single characters; byte ids.
        order = {s: r for r, s in enumerate(sorted({s for s in model.score if s is not None}, reverse=True))}
        self.rank = np.array([order[s] if s is not None else -1 for s in model.score], np.int64)
        self.single = np.full(0x110000, -1, np.int64)
        for i, t in enumerate(model.text):
            if t and len(t) == 1:
                self.single[ord(t)] = i

    def pack(self, rows: np.ndarray) -> list[np.ndarray]:
        """Several characters to a word, so that words compare like strings."""
        out = []
        for w in range(self.words):
            word = np.zeros(rows.shape[1], np.int64)
            for r in rows[w * self.each:(w + 1) * self.each]:
                word = word << self.bits | r
            out.append(word)
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, id) of every occurrence of a piece, by position."""
        padded = np.concatenate([codes, np.zeros(self.words * self.each, np.int64)])
        keys = self.pack(np.lib.stride_tricks.sliding_window_view(padded, len(codes))[:self.words * self.each])
        suffixes = np.argsort(keys[0])
        # Only suffixes whose first word a longer piece begins with need the order of the rest.
        sorted_first = keys[0][suffixes]
        deep = np.unique(self.low[0][self.sizes > self.each])
        lo, hi = np.searchsorted(sorted_first, deep, "left"), np.searchsorted(sorted_first, deep, "right")
        there = X.ragged(lo, hi - lo)
        rest = suffixes[there]
        suffixes[there] = rest[np.lexsort([k[rest] for k in keys[::-1]])]
        keys = [sorted_first, *[k[suffixes] for k in keys[1:]]]
        lo, hi = np.searchsorted(keys[0], self.low[0], "left"), np.searchsorted(keys[0], self.high[0], "right")
        for w in range(1, self.words):
            deep = np.flatnonzero((self.sizes > w * self.each) & (lo < hi))
            lo[deep], hi[deep] = (bisect(keys[w], lo[deep], hi[deep], bound[w][deep], right)
                                  for bound, right in ((self.low, False), (self.high, True)))
        found = np.maximum(hi - lo, 0)
        at = suffixes[X.ragged(lo, found)]
        size, ids = np.repeat(self.sizes, found), np.repeat(self.ids, found)
        by = np.argsort(at * (self.most + 1) + size)
        return at[by], size[by], ids[by]


def bisect(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """Insertion points of many targets, each in its own sorted range of ``keys``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        there = keys[np.minimum(mid, len(keys) - 1)]
        up = open_ & ((there <= target) if right else (there < target))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def merge(table: np.ndarray, rank: np.ndarray, first: np.ndarray, size: np.ndarray, done: np.ndarray) -> None:
    """BPE over many units at once: marks in ``done`` the positions where a symbol starts.

    ``table[p, n]``: id of the piece of n characters at p, or -1. All units
    take one merge a round; a unit with none left leaves.
    """
    live, starts, lengths = np.flatnonzero(size > 1), None, None
    starts, lengths = X.ragged(first[live], size[live]), size[live]
    while len(live):
        ends = np.cumsum(lengths)
        last = np.zeros(len(starts), bool)
        last[ends - 1] = True
        # The symbol after next starts where this pair ends.
        stop = np.empty(len(starts), np.int64)
        stop[:-2] = starts[2:]
        before_last = ends - 2
        has_pair = lengths > 1
        stop[before_last[has_pair]] = (first + size)[live][has_pair]
        span = np.where(last, 0, stop - starts)
        fits = ~last & (span < table.shape[1])
        ids = np.where(fits, table[starts, np.where(fits, span, 0)], -1)
        key = np.where(ids >= 0, rank[ids], np.int64(1) << 31) << 31 | np.arange(len(starts))
        best = np.minimum.reduceat(key, ends - lengths)
        going = best >> 31 < np.int64(1) << 31
        gone = (best & (1 << 31) - 1)[going] + 1
        done[starts[gone]] = False
        stay = np.repeat(going, lengths)
        stay[gone] = False
        starts = starts[stay]
        lengths = lengths[going] - 1
        live = live[going]


def merge_long(table: np.ndarray, rank: np.ndarray, first: int, size: int, done: np.ndarray) -> None:
    """The same for one unit of any length, with a heap."""
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    alive = [True] * size
    heap: list = []

    def offer(a: int) -> None:
        b = after[a]
        if b < size and after[b] - a < table.shape[1] and (i := table[first + a, after[b] - a]) >= 0:
            heapq.heappush(heap, (int(rank[i]), a, b, after[b]))

    for a in range(size - 1):
        offer(a)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if alive[a] and b < size and alive[b] and after[a] == b and after[b] == c:
            alive[b] = done[first + b] = False
            after[a] = c
            if c < size:
                before[c] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)


def relax_long(table: np.ndarray, score: np.ndarray, single: np.ndarray, unk: float, first: int, size: int,
               done: np.ndarray) -> None:
    """Unigram: best path of one unit of any length."""
    best, back = [0.0], [0]
    for end in range(1, size + 1):
        top, step = -np.inf, 0
        for n in range(min(end, table.shape[1] - 1), 0, -1):
            i = table[first + end - n, n] if n > 1 else single[first + end - 1]
            got = best[end - n] + (score[i] if i >= 0 else unk if n == 1 else -np.inf)
            if got > top:
                top, step = got, n
        best.append(top)
        back.append(step)
    done[first:first + size] = False
    while size:
        size -= back[size]
        done[first + size] = True


def relax(table: np.ndarray, score: np.ndarray, single: np.ndarray, unk: float, first: np.ndarray, size: np.ndarray,
          done: np.ndarray) -> None:
    """Unigram: best path of many units at once, position by position."""
    best = np.full(len(done) + 1, -np.inf)
    back = np.zeros(len(done) + 1, np.int64)
    # A unit's end is its separator's position, so the ends of units stay apart.
    best[first] = 0.0
    for depth in range(1, int(size.max(initial=0)) + 1):
        end = first[size >= depth] + depth
        for n in range(min(depth, table.shape[1] - 1), 0, -1):
            start = end - n
            ids = table[start, n] if n > 1 else single[start]
            got = best[start] + np.where(ids >= 0, score[ids], unk if n == 1 else -np.inf)
            better = got > best[end]
            best[end[better]], back[end[better]] = got[better], n
    done[X.ragged(first, size)] = False
    at = (first + size)[size > 0]
    floor = first[size > 0]
    while len(at):
        at = at - back[at]
        done[at] = True
        more = at > floor
        at, floor = at[more], floor[more]


def encode_units(units: list[str], m: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and how many each has."""
    model = m.model
    size = np.fromiter(map(len, units), np.int64, len(units))
    points = P.code_points("\0".join(units) + "\0").astype(np.int64) if units else np.zeros(0, np.int64)
    first = np.cumsum(size + 1) - size - 1
    inside = np.ones(len(points), bool)
    inside[first + size] = False
    codes = np.where(inside, m.code[points], 0)
    at, length, ids = m.edges(codes)
    table = np.full((len(points), m.most + 1), -1, np.int32)
    table[at, length] = ids
    done = inside.copy()
    single = np.where(inside, m.single[points], -1)
    short = size <= LONG_UNIT
    if model.unigram:
        score = np.array([np.nan if s is None else s for s in model.score])
        unk = np.nanmin(score) - P.UNK_PENALTY
        relax(table, score, single, unk, first[short], size[short], done)
        for i in np.flatnonzero(~short):
            relax_long(table, score, single, unk, int(first[i]), int(size[i]), done)
    else:
        merge(table, m.rank, first[short], size[short], done)
        for i in np.flatnonzero(~short):
            merge_long(table, m.rank, int(first[i]), int(size[i]), done)
    starts = np.flatnonzero(done)
    owner = np.repeat(np.arange(len(units)), size + 1)[starts]
    stops = np.append(starts[1:], len(points))
    stops = np.minimum(stops, (first + size)[owner])
    span = stops - starts
    got = np.where(span > 1, table[starts, np.minimum(span, m.most)], single[starts])
    lost = np.flatnonzero(got < 0)
    counts = np.bincount(owner, minlength=len(units))
    if len(lost) and model.fallback:
        raw = [chr(p).encode("utf-8", "surrogatepass") for p in points[starts[lost]].tolist()]
        extra = np.fromiter(map(len, raw), np.int64, len(raw))
        times = np.ones(len(got), np.int64)
        times[lost] = extra
        filled = np.repeat(got, times)
        filled[X.ragged((np.cumsum(times) - times)[lost], extra)] = np.array(model.byte)[np.frombuffer(b"".join(raw), np.uint8)]
        counts = counts + np.bincount(owner[lost], extra - 1, len(units)).astype(np.int64)
        return filled, counts
    got[lost] = model.unk
    return got, counts


def encode_texts(texts: list, m: Matcher, pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each has."""
    units, places, n_units = P.split(texts, pattern)
    parts, at = [], 0
    while at < len(units):
        end, chars = at, 0
        while end < len(units) and (end == at or chars + len(units[end]) < INDEX_CHARS):
            chars += len(units[end]) + 1
            end += 1
        parts.append(encode_units(units[at:end], m))
        at = end
    flat = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    return flat[X.ragged(start[places], size[places])].astype(np.int32), X.sums(size[places], n_units)


def piece_bytes(model: P.Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all ids one after the other, their starts and lengths (none for control ids)."""
    each = [t.replace(P.MARK, " ").encode() if t else b"" for t in model.text]
    for b, i in enumerate(model.byte):
        if i >= 0:
            each[i] = bytes([b])
    if model.unk >= 0:
        each[model.unk] = " ⁇ ".encode()
    size = np.fromiter(map(len, each), np.int64, len(each))
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size


def decode_ids(flat: np.ndarray, counts: np.ndarray, tables) -> list[str]:
    data, start, size = tables
    out = data[X.ragged(start[flat], size[flat])].tobytes()
    ends = np.cumsum(X.sums(size[flat], counts))
    texts = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else ():
        texts.append(out[a + (out[a:a + 1] == b" " and b > a):b].decode("utf-8", "replace"))
    return texts


def encode(docs: DataFrame, model: P.Pieces, keep: list[str] | None = None, text: str = "text",
           check: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all) plus ``ids`` (array of int); with ``check`` instead of them
    ``n_ids``, ``ids_sha256`` (of the ids as little-endian 32-bit integers) and ``round_trip``
    (decoding gives the text back).

    * null or empty text: no ids; the round trip of null is taken as the empty text.
    * a U+2581 in a text is read as a space, as the library does, so such a
      text's round trip gives a space there and ``round_trip`` is false.
    * repeated rows are encoded alike; an empty table gives an empty table;
      kept columns named like the new ones are replaced.
    """
    ints = T.ArrayType(T.IntegerType())
    new = T.StructType([T.StructField("ids", ints)]) if not check else T.StructType([
        T.StructField("n_ids", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType())])

    def make():
        m, pattern, tables = Matcher(model), re.compile(model.unit_pattern(), re.S), piece_bytes(model)

        def work(batch: list) -> list[pa.Array]:
            flat, counts = encode_texts(batch, m, pattern)
            if not check:
                return [X.list_array(flat, counts, pa.int32())]
            back = decode_ids(flat, counts, tables)
            ends = np.cumsum(counts)
            digests = [hashlib.sha256(flat[a:b].astype("<i4").tobytes()).hexdigest()
                       for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            return [pa.array(counts.astype(np.int64)), pa.array(digests, pa.string()),
                    pa.array([x == (t or "") for x, t in zip(back, batch, strict=True)], pa.bool_())]

        return work

    return X.map_texts(docs, text, docs.columns if keep is None else keep, new, make)


def decode(encoded: DataFrame, model: P.Pieces, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` plus the text ``to`` of the ids; null ids or null arrays count as none.

    Invalid UTF-8 becomes U+FFFD, one leading space is taken off, control ids are silent.
    """
    kept = [c for c in encoded.columns if c.lower() != to.lower()]
    at = kept.index(ids)
    schema = T.StructType([T.StructField(f"k{i}", encoded.schema[c].dataType) for i, c in enumerate(kept)]
                          + [T.StructField("new", T.StringType())])

    def run(batches):
        tables = piece_bytes(model)
        for batch in batches:
            lists = [[i for i in x or () if i is not None] for x in batch.column(at).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in lists]])
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_ids(flat, counts, tables), pa.string())],
                                             names=schema.fieldNames())

    return encoded.select(*kept).toDF(*schema.fieldNames()[:-1]).mapInArrow(run, schema).toDF(*kept, to)
