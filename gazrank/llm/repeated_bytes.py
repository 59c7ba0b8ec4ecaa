"""Removal of byte strings that occur twice, from the Burrows-Wheeler transform of a collection.

Method: the transform of many texts and the common prefixes of neighbouring suffixes are built column by column.
In each round every text puts in its next symbol, from its end to its start; the places of the new
suffixes follow from the ranks of the symbols put in before, and the two sequences
are read once and written anew. A suffix whose common prefix with a neighbour reaches ``length`` starts a repeated string.

Which texts form a collection: each window of ``length`` bytes belongs to the least hash of its
``k``-grams (its anchor), so equal windows have equal anchors wherever they stand. The
windows in a row with one anchor make a piece. An anchor with a single piece in the whole corpus has
no repeat, unless the piece has its anchor's gram at two places (a short period) and may repeat a window itself; a piece that occurs twice, byte for byte, is a repeat as a whole; anchors with several different
pieces, or with such a piece, are the collections. An anchor with more than ``MOST`` different pieces is taken apart by
longer grams, at last by whole windows, where equal anchors are equal strings.

Scale: all steps are joins and counts on 64-bit keys, pre-aggregated, over written tables; texts move
once to cut the pieces that are compared and once for the result. A task's collections are taken in
batches of about ``BATCH`` pieces, cut to the parts whose longer anchors their collection has twice, so the sequences are a few hundred KB and stay in memory; the original
keeps them in files because its collection is the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import common as C
from . import texts as X

LENGTH = 200
#: Different pieces of an anchor that may be one collection.
MOST = 4096
#: Pieces to a batch of collections.
BATCH = 1000
#: Bytes of text that are hashed at once; a longer text is cut, with windows overlapping.
SLICE = 1 << 20


def gram_sizes(length: int) -> tuple[int, ...]:
    """Gram sizes of the levels; the last is the whole window."""
    return max(1, length * 8 // 25), max(1, length * 16 // 25), length


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0xD6E8FEB86659FD93)
    h += b
    h ^= h >> np.uint64(32)
    return h


#: Hash of each byte.
_BYTE = B.draw(np.arange(256).astype(np.uint64), 5)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each place on, by doubling."""
    h = _BYTE[x]
    size, out, have = 1, None, 0
    while True:
        if k & size:
            n = max(len(x) - have - size + 1, 0)
            out = h[:n] if out is None else _pair(out[:n], h[have:have + n])
            have += size
        if 2 * size > k:
            return B.draw(out, 6)
        n = max(len(h) - size, 0)
        h, size = _pair(h[:n], h[size:size + n]), 2 * size


def least_of(v: np.ndarray, w: int) -> np.ndarray:
    """The least of the ``w`` values from each place on."""
    have = 1
    while 2 * have <= w:
        v, have = np.minimum(v[:-have], v[have:]), 2 * have
    return np.minimum(v[:len(v) - (w - have)], v[w - have:]) if w > have else v


def _anchored_twice(grams: np.ndarray, anchor: np.ndarray, first: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Whether each piece has its anchor's gram at two places or more; without that its windows all differ."""
    # Grams that are the anchor of a window over them: the highest of these windows' anchors is no lower.
    edge = np.zeros(most - 1, np.uint64)
    highest = ~least_of(~np.concatenate([edge, anchor, edge]), most)
    place = np.flatnonzero(highest == grams)
    low = np.searchsorted(place, first)
    number = np.searchsorted(place, first + n + most - 1) - low
    own = grams[place[X.ragged(low, number)]] == np.repeat(anchor[first], number)
    return X.sums(own.astype(np.int64), number) > 1


def cut(x: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts in a row: (text, first window, windows, anchor, hash of the piece)."""
    return cut_marked(x, sizes, length, k)[:-1]


def cut_marked(x: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The pieces of :func:`cut`, and whether a window may occur twice in the piece itself."""
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    grams = gram_hashes(x, k)
    anchor = least_of(grams, length - k + 1)
    most = length - k + 1
    end = np.cumsum(sizes)
    at = X.ragged(end - sizes, np.maximum(sizes - length + 1, 0))  # the windows, text after text
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (np.diff(at) != 1)
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(at)))
    parts = -(-run // most)  # a long run of one anchor (a periodic text) in parts
    first = np.repeat(start, parts) + X.ragged(np.zeros(len(run), np.int64), parts) * most
    n = np.diff(np.append(first, len(at)))
    s = at[first]
    last = s + n + length - 1 - k
    key = _pair(grams[s], grams[last])
    for step in range(1, (2 * length - k) // k + 1):
        place = s + step * k
        inside = np.flatnonzero(place < last)
        key[inside] = _pair(key[inside], grams[place[inside]])
    key = _pair(key, n.astype(np.uint64))
    doc = np.searchsorted(end, s, "right")
    return doc, s - (end - sizes)[doc], n, anchor[s], key, _anchored_twice(grams, anchor, s, n, most)


def transform(symbols: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of texts and the common prefix of each suffix with the one before, at most ``cap``.

    ``symbols`` (1 to 255) are the texts one after the other; each ends in a mark (0) less than all, and the marks
    are ordered as the texts are.
    """
    n = len(sizes)
    padded = np.concatenate([np.zeros(1, np.uint8), symbols])
    first = np.cumsum(sizes) - sizes
    bwt = np.where(sizes > 0, padded[first + sizes], 0).astype(np.uint8)
    lcp = np.zeros(n + 1, np.uint8 if cap < 256 else np.uint32)
    row = np.flatnonzero(sizes > 0)  # rows of the newest suffixes, and their texts
    text = row
    done = 0
    while len(row):
        done += 1
        fresh = np.zeros(len(bwt), bool)
        fresh[row] = True
        owner = np.empty(len(bwt), np.int32)
        owner[row] = text
        order = symbol_order(bwt)
        new = np.append(fresh[order], True)
        at = np.flatnonzero(new)[:-1]
        text = owner[order[at]]
        left = sizes[text] - done
        put = np.where(left > 0, padded[first[text] + np.maximum(left, 0)], 0)
        old = ~new[:-1]
        next_bwt = np.empty(n + len(order), np.uint8)
        next_lcp = np.empty(n + len(order) + 1, lcp.dtype)
        next_bwt[:n] = bwt[:n]
        next_lcp[:n] = next_lcp[-1] = 0
        body, common = next_bwt[n:], next_lcp[n:-1]
        body[old], body[at] = bwt[n:], put
        common[old] = lcp[n:-1]
        # New rows and those behind them: one more than the least between their tails.
        behind = at + 1
        t = np.concatenate([at[1:] if at[0] == 0 else at, behind[~new[behind]]])
        low, high = order[t - 1] + 1, order[t] + 1
        value = np.zeros(len(t), lcp.dtype)
        same = np.flatnonzero(bwt[low - 1] == bwt[high - 1])
        if len(same):
            same = same[np.argsort(-low[same])]  # so that the spans between two ranges are empty
            value[same] = np.minimum(np.minimum.reduceat(lcp, np.stack([low[same], high[same]], axis=1).ravel())[::2], cap - 1) + 1
        common[t] = value
        if at[0] == 0:
            common[0] = 0
        bwt, lcp = next_bwt, next_lcp
        row, text = n + at[put > 0], text[put > 0]
    return bwt, lcp[:-1]


def symbol_order(bwt: np.ndarray) -> np.ndarray:
    """Rows by symbol, stable, without the marks: the rows' tails in the order of the suffixes."""
    order = pc.array_sort_indices(pa.array(bwt)).to_numpy(zero_copy_only=False).view(np.int64)
    return order[len(bwt) - np.count_nonzero(bwt):]


def repeated_starts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, n) of the runs of starts whose ``length`` bytes occur twice or more in the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 3
    bwt, lcp = transform(np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1), sizes, length)
    reach = np.append(lcp >= length, False)
    hit = reach[:-1] | reach[1:]
    n = len(sizes)
    order = symbol_order(bwt)
    tail = np.zeros(len(bwt), np.int64)
    tail[order] = n + np.arange(len(order))
    windows = np.maximum(sizes - length + 1, 0)
    base = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), bool)
    row, text = np.arange(n), np.arange(n)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[text] >= j
        text, row = text[going], tail[row[going]]
        if j >= length:
            found[base[text] + sizes[text] - j] = hit[row]
    doc = np.repeat(np.arange(n), windows)
    start = found.copy()
    start[1:] &= ~found[:-1] | (doc[1:] != doc[:-1])
    stop = found.copy()
    stop[:-1] &= ~found[1:] | (doc[1:] != doc[:-1])
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    return doc[a], a - base[doc[a]], b - a + 1


def shared_parts(texts: list[bytes], collection: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of the parts whose windows' anchors, for grams of four fifths of a window, occur twice in the text's collection or the part.

    A window that occurs twice lies in such a part, whole.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc, first, n, anchor, _, own = cut_marked(np.frombuffer(b"".join(texts), np.uint8), sizes, length, max(1, length * 4 // 5))
    _, which, times = np.unique(_pair(anchor, collection[doc]), return_inverse=True, return_counts=True)
    keep = (times[which] > 1) | own
    doc, first, n = doc[keep], first[keep], n[keep]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.append(at, len(doc))[1:] - 1
    return doc[at], first[at], first[end] + n[end] - first[at] + length - 1


_PIECES = T.StructType([*[T.StructField(c, T.LongType()) for c in ("m", "p", "k1", "k2", "first", "n")], T.StructField("own", T.BooleanType())])


def _pieces(source: DataFrame, length: int, k: int) -> DataFrame:
    """Pieces of the rows (``k1``, ``k2``, ``t``: bytes) of ``source``."""

    def flush(keys: list, parts: list) -> pa.RecordBatch:
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        doc, first, n, m, p, own = cut_marked(np.frombuffer(b"".join(parts), np.uint8), sizes, length, k)
        k1, k2, offset = (np.array(a, np.int64) for a in zip(*keys, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (m.view(np.int64), p.view(np.int64), k1[doc], k2[doc], offset[doc] + first, n, own)],
                                          names=_PIECES.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for batch in batches:
            for k1, k2, t in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), strict=True):
                whole = memoryview(t.as_buffer()) if t.is_valid else b""
                for at in range(0, max(len(whole) - length + 1, 0), SLICE):
                    part = whole[at:at + SLICE + length - 1]
                    keys.append((k1, k2, at))
                    parts.append(part)
                    held += len(part)
                    if held >= SLICE:
                        yield flush(keys, parts)
                        keys, parts, held = [], [], 0
        if parts:
            yield flush(keys, parts)

    return source.select("k1", "k2", "t").mapInArrow(run, _PIECES)


_CUT = T.StructType([T.StructField("m", T.LongType()), T.StructField("p", T.LongType()), T.StructField("t", T.BinaryType())])
_SPANS = T.StructType([T.StructField(c, T.LongType()) for c in ("m", "p", "from", "n")])


def _texts_of(wanted: DataFrame, source: DataFrame, length: int) -> DataFrame:
    """The bytes ``t`` of the pieces ``wanted`` (m, p and the place of one of each), cut from ``source``."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "p", "first", "n")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                out: list = []
                for t, cuts in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    whole = memoryview(t.as_buffer())
                    out += [(c["m"], c["p"], bytes(whole[c["first"]:c["first"] + c["n"] + length - 1])) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in
                                                  enumerate((pa.int64(), pa.int64(), pa.binary()))], names=_CUT.fieldNames())

    # Repeated rows have the same key: one of each piece is enough.
    made = source.join(lists, ["k1", "k2"]).select("t", "cuts").mapInArrow(run, _CUT)
    return made.groupBy("m", "p").agg(F.first("t").alias("t"))


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows (``from``, ``n``) in the pieces (m, p, t) of collections m."""

    def solve(rows: list) -> pa.RecordBatch:
        m, p = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        doc, at, size = shared_parts([r[2] for r in rows], m.view(np.uint64), length)
        part, first, n = repeated_starts([rows[d][2][a:a + z] for d, a, z in zip(doc.tolist(), at.tolist(), size.tolist(), strict=True)], length)
        doc = doc[part]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (m[doc], p[doc], at[part] + first, n)], names=_SPANS.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    dealt = pieces.select("m", "p", "t").repartition(C.shuffle_partitions(pieces.sparkSession), "m").sortWithinPartitions("m", "p")
    return dealt.mapInArrow(run, _SPANS)


def repeated_windows(source: DataFrame, length: int, most: int = MOST, level: int = 0) -> DataFrame:
    """Runs (``k1``, ``k2``, ``first``, ``n``) of starts in the rows (``k1``, ``k2``, ``t``) of ``source`` whose window occurs elsewhere too."""
    cuts = C.stored(_pieces(source, length, gram_sizes(length)[level]), "pieces")
    often = cuts.groupBy("m").agg(F.count("*").alias("count"), F.max("own").alias("own")).filter("count > 1 or own")
    columns = _PIECES.fieldNames()
    members = C.stored(cuts.join(often.select("m"), "m", "left_semi").groupBy(*columns).agg(F.count("*").alias("times")),
                       "members", free=True)
    C.drop_stored(cuts)
    copies = C.stored(members.groupBy("m", "p").agg(F.sum("times").alias("copies"), F.min(F.struct("k1", "k2", "first", "n")).alias("one"),
                                                          F.max("own").alias("own")).select("m", "p", "copies", "own", "one.*"), "copies", free=True)
    several = copies.groupBy("m").agg(F.count("*").alias("texts"), F.max(F.expr("own and copies = 1")).alias("own")).filter("texts > 1 or own").drop("own")
    wanted = copies.join(several, "m")
    texts = C.stored(_texts_of(wanted, source, length), "texts", free=True)
    hot = C.stored(several.filter(F.col("texts") > most).select("m"), "hot", free=True)
    found = copies.filter("copies > 1").select("m", "p", F.lit(0).cast("long").alias("from"), "n")
    found = found.unionByName(C.stored(_compared(texts.join(hot, "m", "left_anti"), length), "spans", free=True))
    if not hot.isEmpty():
        inner = texts.join(hot, "m", "left_semi").select(F.col("m").alias("k1"), F.col("p").alias("k2"), "t")
        found = found.unionByName(repeated_windows(C.stored(inner, "hot-texts", free=True), length, most, level + 1).select(
            F.col("k1").alias("m"), F.col("k2").alias("p"), F.col("first").alias("from"), "n"))
    C.drop_stored(texts)
    return C.stored(members.select("m", "p", "k1", "k2", "first").join(found, ["m", "p"]).select(
        "k1", "k2", (F.col("first") + F.col("from")).alias("first"), "n").distinct(), "repeats", free=True)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """For each row its id, ``n_bytes``, ``spans`` (removed byte ranges ``start``, ``stop``, maximal) and ``kept`` (the other bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another; all strings are judged on the input. No string goes over the end of a text.

    * null texts are empty; texts of fewer than ``length`` bytes stay whole.
    * equal rows are each other's repeats: both lose all their bytes, if there are ``length``.
    * bytes are UTF-8; ``kept`` may part a character and so is binary.
    * a text whose every window is equal (a periodic one) loses all; a string that overlaps itself counts.
    * a null id is one like any other; an empty table gives an empty table; extra columns are not looked at.
    * a very long text is hashed in overlapping slices; the result does not depend on them.
    """
    key = dict(zip(("k1", "k2"), C.row_key(F.col(id_col), F.col(text)), strict=True))
    data: Column = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    source = docs.select(*[c.alias(n) for n, c in key.items()], data.alias("t"))
    # Runs of a text: no more than its length, and each once.
    runs = repeated_windows(source.filter(F.length("t") >= length), length, most).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("first", "n")).alias("runs"))
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in key.items()], data.alias("t"))
    joined = rows.join(runs, ["k1", "k2"], "left").select("id", "t", "runs")
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop")])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.chunks(batch, 1, SLICE * 4):
                sizes, spans, kept = [], [], []
                for t, got in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    whole = memoryview(t.as_buffer())
                    done, keep, at = [], [], 0
                    for a, b in sorted((r["first"], r["first"] + r["n"] + length - 1) for r in got or ()):
                        if done and a <= done[-1][1]:
                            done[-1] = (done[-1][0], max(done[-1][1], b))
                        else:
                            done.append((a, b))
                    for a, b in done:
                        keep.append(whole[at:a])
                        at = b
                    keep.append(whole[at:])
                    sizes.append(len(whole))
                    spans.append([{"start": a, "stop": b} for a, b in done])
                    kept.append(b"".join(keep))
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds),
                                                  pa.array(kept, pa.binary())], names=schema.fieldNames())

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
