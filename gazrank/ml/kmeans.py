"""k-means whose centres never are vectors on the driver (MOD10, MOD13-MOD15).

A centre is a weighted mean of rows, so its rows and their weights name it: one number for each row instead of one for
each term and centre. The entries of the rows are dealt into buckets of dimensions. A pass makes the centres'
values in each bucket from these weights, multiplies them with the bucket's rows, and the products of all
buckets are added for chunks of rows, where each row's nearest centre is found. Fits on several
weightings of the same rows (bootstrap samples) share the passes.

Starting centres are those of k-means||: two rounds of rows drawn by their distance, which are weighted by the rows nearest
to them and parted by k-means++ and Lloyd's rounds on their mutual distances.

The driver holds a few vectors of one number for each row and fit.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import with_position
from ..session import materialize

#: Entries and dimensions of a bucket, about.
BUCKET_ENTRIES, BUCKET_DIMS = 1_000_000, 50_000
#: Rows of a chunk, centres of a pass, and entries that are multiplied at once.
CHUNK, AT_ONCE, PIECE = 1024, 128, 1 << 15
#: Rounds of draws of the start, and of Lloyd's on the drawn rows.
DRAWS, START_ROUNDS = 2, 30

_TILE = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("dims", "row", "code", "value")])
_PART = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())])
_NEAR = T.StructType([T.StructField("chunk", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("best", "apart", "asked")])
_CELL = T.StructType([T.StructField("centre", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("cvalue", T.DoubleType())])


@dataclass
class Centres:
    """Centres as rows: ``row`` counts in ``centre`` with ``share`` (the shares of a centre add up to 1)."""

    row: np.ndarray
    centre: np.ndarray
    share: np.ndarray
    k: int


@dataclass
class Tiled:
    """Rows numbered along their id (``rows``: id, row), their entries in buckets of dimensions, and their squared lengths."""

    rows: DataFrame
    tiles: DataFrame
    norms: np.ndarray
    id_col: str

    @property
    def n(self) -> int:
        return len(self.norms)

    def close(self) -> None:
        self.tiles.unpersist()


def vector_entries(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, dim, value)`` of the non-zero entries of a vector column."""
    v = F.unwrap_udt("features")
    at = F.coalesce(v["indices"], F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)))
    pairs = F.arrays_zip(at.alias("dim"), v["values"].alias("value"))
    return features.select(id_col, F.explode(pairs).alias("e")).select(id_col, "e.dim", "e.value").filter("value <> 0")


def tiled(ids: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> Tiled:
    """Rows with the different ``ids`` and their non-zero ``entries`` (id, dim, value) as passes read them."""
    spark = ids.sparkSession
    rows = with_position(ids.select(id_col), [id_col], name="_p").select(id_col, (F.col("_p") - 1).cast("int").alias("row"))
    rows = materialize(rows)
    entries = materialize(entries.join(rows, id_col).select("row", "dim", "value"))
    total, dims = entries.agg(F.count(F.lit(1)), F.approx_count_distinct("dim")).first()
    buckets = max(2 * spark.sparkContext.defaultParallelism, total // BUCKET_ENTRIES, dims // BUCKET_DIMS)

    def pack(table: pa.Table) -> pa.Table:
        bucket, row, dim, value = (table.column(c).to_numpy() for c in ("bucket", "row", "dim", "value"))
        by = np.lexsort([dim, row])
        names, code = np.unique(dim[by], return_inverse=True)
        binary = [names.astype(np.int32), row[by].astype(np.int32), code.astype(np.int32), value[by].astype(np.float64)]
        return pa.Table.from_arrays([pa.array(bucket[:1], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in binary]],
                                    names=_TILE.fieldNames())

    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("dim"), F.lit(buckets)).cast("int"))
    tiles = materialize(dealt.groupBy("bucket").applyInArrow(pack, _TILE)).persist()
    norms = np.zeros(rows.count())
    own = entries.groupBy("row").agg(F.sum(F.col("value") ** 2).alias("xn")).toArrow()
    norms[own.column("row").to_numpy()] = own.column("xn").to_numpy()
    return Tiled(rows, tiles, norms, id_col)


def _read(tile: dict) -> tuple:
    return tuple(np.frombuffer(tile[c], t) for c, t in (("dims", np.int32), ("row", np.int32), ("code", np.int32), ("value", np.float64)))


def _placed(c: Centres, n: int) -> tuple:
    """The shares by row: where each row's begin and how many it has, their centres and values."""
    by = np.argsort(c.row, kind="stable")
    count = np.bincount(c.row, minlength=n)
    return np.cumsum(count) - count, count, c.centre[by].astype(np.int32), c.share[by]


def _centre_values(placed: tuple, row, code, value, n_dims: int, k: int) -> np.ndarray:
    """The bucket's part of all centres, (dimension, centre)."""
    start, count, centre, share = placed
    of = np.repeat(np.arange(len(row)), count[row])
    at = np.arange(len(of)) - np.repeat(np.cumsum(count[row]) - count[row], count[row]) + start[row[of]]
    cell = code[of].astype(np.int64) * k + centre[at]
    return np.bincount(cell, value[of] * share[at], minlength=n_dims * k).reshape(n_dims, k)


def _pass(data: Tiled, centres: Centres, segments: list[tuple[int, int]], asked: list[np.ndarray]) -> list[tuple]:
    """For each segment (range of centres) every row's nearest centre in it, the squared distance, and
    the distances of the rows ``asked`` of the segment to all its centres."""
    n, k, norms = data.n, centres.k, data.norms
    placed, wanted = _placed(centres, n), [np.sort(a) for a in asked]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                dims, row, code, value = _read(tile)
                own = _centre_values(placed, row, code, value, len(dims), k)
                length = (own * own).sum(axis=0)
                for chunk in range(math.ceil(n / CHUNK)):
                    low, high = np.searchsorted(row, [chunk * CHUNK, (chunk + 1) * CHUNK])
                    out = np.zeros((min(CHUNK, n - chunk * CHUNK) + 1, k))
                    out[-1] = length
                    for a in range(low, high, PIECE):
                        r = row[a:min(a + PIECE, high)] - chunk * CHUNK
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        part = own[code[a:a + len(r)]] * value[a:a + len(r), None]
                        out[r[first]] += np.add.reduceat(part, first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([tile["bucket"]], pa.int32()), pa.array([chunk], pa.int32()),
                                                      pa.array([out.tobytes()], pa.binary())], names=_PART.fieldNames())

    def nearest(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")  # sums of one order, whatever came first
        total = sum(np.frombuffer(x.as_py()).reshape(-1, k) for x in table.column("data"))
        chunk = table.column("chunk")[0].as_py()
        x, length = norms[chunk * CHUNK:(chunk + 1) * CHUNK, None], total[-1]
        d = x + length - 2 * total[:-1]
        d[d < 1e-12 * (x + length)] = 0.0
        best = np.concatenate([d[:, a:b].argmin(axis=1) for a, b in segments]).astype(np.int32)
        apart = np.concatenate([d[:, a:b].min(axis=1) for a, b in segments])
        held = [w[slice(*np.searchsorted(w, [chunk * CHUNK, (chunk + 1) * CHUNK]))] - chunk * CHUNK for w in wanted]
        asked_for = np.concatenate([d[h, a:b].ravel() for h, (a, b) in zip(held, segments, strict=True)])
        return pa.Table.from_arrays([pa.array([chunk], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (best, apart, asked_for)]],
                                    names=_NEAR.fieldNames())

    got = data.tiles.mapInArrow(multiply, _PART).groupBy("chunk").applyInArrow(nearest, _NEAR).toArrow().sort_by("chunk")
    best = [[] for _ in segments]
    apart, far = [[] for _ in segments], [[] for _ in segments]
    for b, d, m in zip(*(got.column(c) for c in ("best", "apart", "asked")), strict=True):
        for i, part in enumerate(np.split(np.frombuffer(b.as_py(), np.int32), len(segments))):
            best[i].append(part)
        for i, part in enumerate(np.split(np.frombuffer(d.as_py(), np.float64), len(segments))):
            apart[i].append(part)
        m, chunk, at = np.frombuffer(m.as_py(), np.float64), len(best[0]) - 1, 0
        for i, (w, (low, high)) in enumerate(zip(wanted, segments, strict=True)):
            size = int(np.diff(np.searchsorted(w, [chunk * CHUNK, (chunk + 1) * CHUNK]))[0]) * (high - low)
            far[i].append(m[at:at + size].reshape(-1, high - low))
            at += size
    return [tuple(np.concatenate(x[i]) for x in (best, apart, far)) for i in range(len(segments))]


#: A fit asks for the nearest of some centres and, for some rows, the distances to all of them.
_Fit = Generator[tuple[Centres, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray], tuple[Centres, np.ndarray]]


def _served(data: Tiled, asks: list[tuple[Centres, np.ndarray]]) -> list[tuple]:
    """The answers to the requests of all fits, by passes over at most ``AT_ONCE`` centres."""
    pieces = [(i, a, min(a + AT_ONCE, c.k)) for i, (c, _) in enumerate(asks) for a in range(0, c.k, AT_ONCE)]
    groups: list[list] = []
    for p in pieces:
        if not groups or sum(b - a for _, a, b in groups[-1]) + p[2] - p[1] > AT_ONCE:
            groups.append([])
        groups[-1].append(p)
    out: list[list] = [[] for _ in asks]
    for group in groups:
        row, centre, share, segments, at = [], [], [], [], 0
        for i, a, b in group:
            c = asks[i][0]
            of = (c.centre >= a) & (c.centre < b)
            row.append(c.row[of])
            centre.append(c.centre[of] - a + at)
            share.append(c.share[of])
            segments.append((at, at + b - a))
            at += b - a
        whole = Centres(np.concatenate(row), np.concatenate(centre), np.concatenate(share), at)
        for (i, a, _), (best, apart, far) in zip(group, _pass(data, whole, segments, [asks[i][1] for i, _, _ in group]), strict=True):
            out[i].append((best + a, apart, far))
    answers = []
    for parts in out:
        apart = np.stack([p[1] for p in parts])
        which = apart.argmin(axis=0)
        best = np.stack([p[0] for p in parts])[which, np.arange(data.n)]
        answers.append((best, apart.min(axis=0), np.concatenate([p[2] for p in parts], axis=1)))
    return answers


def _means(label: np.ndarray, weight: np.ndarray, k: int, old: Centres | None = None) -> Centres:
    """The weighted means of the rows of each label (negative: none); a centre without rows stays as it was."""
    row = np.flatnonzero((label >= 0) & (weight > 0))
    total = np.bincount(label[row], weight[row], minlength=k)
    centre = label[row]
    share = weight[row] / total[centre]
    if old is not None and (total == 0).any():
        stay = total[old.centre] == 0
        row, centre, share = (np.concatenate(x) for x in ((row, old.row[stay]), (centre, old.centre[stay]), (share, old.share[stay])))
    return Centres(row, centre, share, k)


def start_labels(apart: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """Labels of drawn rows, from their mutual squared distances: k-means++, then Lloyd's rounds. Fewer
    different rows than ``k`` give fewer labels."""
    picked = [int(rng.choice(len(weight), p=weight / weight.sum()))]
    nearest = apart[picked[0]].copy()
    while len(picked) < k and (mass := weight * nearest).sum() > 0:
        picked.append(int(rng.choice(len(weight), p=mass / mass.sum())))
        nearest = np.minimum(nearest, apart[picked[-1]])
    label = apart[:, picked].argmin(axis=1)
    for _ in range(START_ROUNDS):
        share = np.zeros((len(weight), len(picked)))
        share[np.arange(len(weight)), label] = weight
        total = share.sum(axis=0)
        if (total == 0).any():
            break
        share /= total
        # |x - mean|^2 by the distances alone
        d = apart @ share - (share * (apart @ share)).sum(axis=0) / 2
        new = d.argmin(axis=1)
        if (new == label).all() or len(np.unique(new)) < len(picked):
            break
        label = new
    return label


def _fit(weight: np.ndarray, k: int, seed: int, max_iter: int) -> _Fit:
    """One k-means on rows with ``weight`` (0: only labelled); yields its requests, returns centres and labels."""
    rng = np.random.default_rng(seed)
    n, none = len(weight), np.zeros(0, np.int64)

    def single(rows):
        return Centres(rows, np.arange(len(rows)), np.ones(len(rows)), len(rows))

    drawn = rng.choice(n, 1, p=weight / weight.sum())
    _, apart, _ = yield single(drawn), none
    rounds = 0
    while True:
        mass = weight * apart
        if mass.sum() > 0:
            new = np.flatnonzero(rng.random(n) < np.minimum(2 * k * mass / mass.sum(), 1.0))
            rounds += 1
            if len(new):
                drawn = np.concatenate([drawn, new])
                if rounds < DRAWS:
                    _, nearer, _ = yield single(new), none
                    apart = np.minimum(apart, nearer)
                    continue
            else:
                continue
        drawn = np.sort(drawn)
        best, apart, far = yield single(drawn), drawn
        label = start_labels(far, np.bincount(best, weight, minlength=len(drawn)), k, rng)
        found = int(label.max()) + 1
        if found == k or not (weight * apart).sum() > 0:
            break
    first = np.full(n, -1)
    first[drawn] = label
    mass = np.zeros(n)
    mass[drawn] = np.bincount(best, weight, minlength=len(drawn))
    centres, old = _means(first, mass, found), None
    for _ in range(max_iter):
        label, _, _ = yield centres, none
        if old is not None and (label == old)[weight > 0].all():
            return centres, label
        centres, old = _means(label, weight, found, centres), label
    label, _, _ = yield centres, none
    return centres, label


def fit(data: Tiled, weights: list[np.ndarray], k: int, seeds: list[int], max_iter: int) -> list[tuple[Centres, np.ndarray]]:
    """A k-means for each of ``weights`` (one number for each row); centres and the label of every row."""
    fits = [_fit(w, k, s, max_iter) for w, s in zip(weights, seeds, strict=True)]
    done: dict[int, tuple] = {}
    asks = {i: next(f) for i, f in enumerate(fits)}
    while asks:
        answers = _served(data, list(asks.values()))
        for i, answer in zip(list(asks), answers, strict=True):
            try:
                asks[i] = fits[i].send(answer)
            except StopIteration as end:
                done[i] = end.value
                del asks[i]
    return [done[i] for i in range(len(fits))]


def labelled(data: Tiled, label: np.ndarray, name: str) -> DataFrame:
    """``(id, name)``: each row's label."""
    def look(row):
        return pd.Series(label[row.to_numpy()].astype(np.int32))

    look.__annotations__ = {"row": pd.Series, "return": pd.Series}
    return data.rows.select(data.id_col, F.pandas_udf(look, "int")("row").alias(name))


def centre_cells(data: Tiled, centres: Centres) -> DataFrame:
    """``(centre, dim, cvalue)`` of the non-zero values of the centres."""
    placed, k = _placed(centres, data.n), centres.k

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                dims, row, code, value = _read(tile)
                own = _centre_values(placed, row, code, value, len(dims), k)
                d, c = np.nonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(dims[d]), pa.array(own[d, c])],
                                                 names=_CELL.fieldNames())

    return data.tiles.mapInArrow(make, _CELL)
