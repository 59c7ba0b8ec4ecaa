"""Ridge regressions of many penalties and many feature weightings from shared data passes (EVA7, EVA8).

All weightings (binary or counts, idf, row norm, weights of text columns) are functions of the same
counts, so the counts are made once. For one weighting, all penalties are solved by one run of
conjugate gradients: the systems ``(X'X + alpha I) b = X'y`` differ by a multiple of the identity, so
they share their Krylov space, and each step needs one product ``X'(X v)`` for all of them
(multi-shift CG). A pass over the rows makes that product for every weighting that has not ended yet.

The intercept is free of penalty: columns and label are centred, the former inside the product. The driver
holds a vector of coefficients for each candidate, as it does for any MLlib linear model.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .vectorizers import combined, stacked  # noqa: F401  (stacked: entries of sparse vectors)

#: Numbers to a row when partial sums are added up.
CHUNK = 1 << 16
#: Coefficients that go out with one scoring pass.
MOST_SENT = 1 << 24


@dataclass(frozen=True)
class Weighting:
    """How counts become features. ``weights``: one for each text column, combined by ``agg`` (max or sum)."""

    binary: bool = True
    use_idf: bool = False
    norm: str | None = None
    weights: tuple = (1.0,)
    agg: str = "max"

    def values(self, counts: np.ndarray, idx: np.ndarray, row: np.ndarray, n_rows: int, idf: np.ndarray) -> np.ndarray:
        """Feature values of the entries; ``counts`` has a column for each text column."""
        w = np.array(self.weights)
        each = (counts > 0) * w if self.binary else counts * w
        value = each.sum(axis=1) if self.agg == "sum" else each.max(axis=1, initial=-np.inf) if len(each) else np.zeros(0)
        if self.use_idf:
            value = value * idf[idx]
        if self.norm:
            size = np.bincount(row, np.abs(value) if self.norm == "l1" else value * value, n_rows)
            size = size if self.norm == "l1" else np.sqrt(size)
            value = value / np.where(size > 0, size, 1.0)[row]
        return value


def counted_rows(df: DataFrame, model: CountVectorizerModel, term_cols: list[str], keep: list[str], label: str, extra: str) -> DataFrame:
    """The written table of rows: ``keep``, ``y``, ``e`` (one more feature), ``idx`` and ``counts`` (for each index, one number a column)."""
    names = []
    df = df.select(*keep, F.col(label).cast("double").alias("y"), F.col(extra).cast("double").alias("e"), *term_cols)
    for i, c in enumerate(term_cols):
        df = model.copy({model.inputCol: c, model.outputCol: f"_v{i}"}).transform(df)
        names.append(f"_v{i}")
    base = df.select(*keep, "y", "e", *names)
    schema = T.StructType([*base.schema.fields[:len(keep) + 2], T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            columns = batch.columns[len(keep) + 2:]
            row, idx, value = stacked(columns, [1.0] * n)
            column = np.repeat(np.arange(n), [len(c.field("indices").flatten()) for c in columns])
            at, place = np.unique(row * (1 << 32) + idx, return_inverse=True)
            table = np.zeros((len(at), n))
            table[place, column] = value
            ends = np.searchsorted(at >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep) + 2], pa.ListArray.from_arrays(pa.array(ends), pa.array((at & 0xFFFFFFFF).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends * n), pa.array(table.ravel()))], names=schema.fieldNames())

    return materialize(base.mapInArrow(run, schema))


def _opened(batch: pa.RecordBatch, n_columns: int):
    """y, e, row and index of each entry, counts."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    lists = get("idx")
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return (get("y").to_numpy(zero_copy_only=False), get("e").to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), n),
            lists.flatten().to_numpy(zero_copy_only=False), get("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_columns))


def _added(rows: DataFrame, size: int, n_columns: int, make, sent) -> list[np.ndarray]:
    """Sums over all rows of the vectors (``size`` numbers each) that ``make(sent, y, e, row, idx, counts)`` yields a batch."""
    held = rows.sparkSession.sparkContext.broadcast(sent)
    parts = T.StructType([T.StructField("job", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] = []
        for batch in batches:
            made = list(make(held.value, *_opened(batch, n_columns)))
            total = [a + b for a, b in zip(total, made, strict=True)] if total else made
        for job, vector in enumerate(total):
            cuts = range(0, size, CHUNK)
            yield pa.RecordBatch.from_arrays([
                pa.array([job] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()),
                pa.array([vector[c:c + CHUNK].tobytes() for c in cuts], pa.binary())], names=parts.fieldNames())

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("data"))
        return pa.table([table.column("job").slice(0, 1), table.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())],
                        names=parts.fieldNames())

    out: dict[int, list] = {}
    for r in rows.select("y", "e", "idx", "counts").mapInArrow(run, parts).groupBy("job", "chunk").applyInArrow(add, parts).collect():
        out.setdefault(r["job"], []).append((r["chunk"], r["data"]))
    held.destroy()
    return [np.concatenate([np.frombuffer(d, np.float64) for _, d in sorted(out[j])]) for j in sorted(out)]


class Shifted:
    """Multi-shift conjugate gradients for ``(A + alpha I) b = c``, one step at a time."""

    def __init__(self, c: np.ndarray, alphas: list[float], tol: float):
        self.shift = np.array(alphas, float)
        self.low = float(self.shift.min())
        self.delta = (self.shift - self.low)[:, None]
        n = len(alphas)
        self.x, self.r, self.p = np.zeros((n, len(c))), c.copy(), c.copy()
        self.ps = np.tile(c, (n, 1))
        self.zeta = self.zeta_before = np.ones((n, 1))
        self.beta_before, self.alpha = 1.0, 0.0
        self.rr, self.stop = float(c @ c), tol * tol * float(c @ c)

    @property
    def ended(self) -> bool:
        return self.rr <= self.stop

    def step(self, ap: np.ndarray) -> None:
        """One step, given the product of ``A`` and ``self.p``."""
        q = ap + self.low * self.p
        beta = -self.rr / float(self.p @ q)
        zeta, before = self.zeta, self.zeta_before
        new = zeta * before * self.beta_before / (
            beta * self.alpha * (before - zeta) + before * self.beta_before * (1 - self.delta * beta))
        beta_s = beta * new / zeta
        self.x -= beta_s * self.ps
        self.r += beta * q
        rr = float(self.r @ self.r)
        self.alpha = rr / self.rr
        self.p = self.r + self.alpha * self.p
        self.ps = new * self.r + self.alpha * new * beta_s / (zeta * beta) * self.ps
        # A solution that has converged far beyond the others stops moving.
        new[np.abs(new) < 1e-150] = 1e-150
        self.zeta_before, self.zeta, self.beta_before, self.rr = zeta, new, beta, rr


@dataclass
class Path:
    """Coefficients (a row for each penalty; the last is that of ``e``), intercepts, seconds."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    seconds: float


def fit_paths(rows: DataFrame, n_terms: int, weightings: list[Weighting], alphas: list[float], tol: float = 1e-7,
              max_steps: int = 1000) -> tuple[np.ndarray, list[Path]]:
    """The idf of each term, and for each weighting the ridge solutions of all ``alphas`` on ``rows``."""
    size, n_columns = n_terms + 1, len(weightings[0].weights)

    def first(_, y, e, row, idx, counts):
        yield np.append(np.bincount(idx, (counts > 0).any(axis=1), n_terms), 0.0)
        yield np.append([len(y), y.sum()], np.zeros(size))[:size] if size > 1 else np.array([float(len(y))])

    seen, sums = _added(rows, size, n_columns, first, None)
    n, mean_y = sums[0], (sums[1] / sums[0] if size > 1 else 0.0)
    idf = np.log((1.0 + n) / (1.0 + seen[:n_terms])) + 1.0

    def back(value, e, row, idx, s):
        return np.append(np.bincount(idx, value * s[row], n_terms), (e * s).sum())

    def second(sent, y, e, row, idx, counts):
        idf, mean_y = sent
        for w in weightings:
            value = w.values(counts, idx, row, len(y), idf)
            yield back(value, e, row, idx, np.ones(len(y)))
            yield back(value, e, row, idx, y - mean_y)

    def product(sent, y, e, row, idx, counts):
        idf, vectors = sent
        for w, v in vectors:
            value = w.values(counts, idx, row, len(y), idf)
            yield back(value, e, row, idx, np.bincount(row, value * v[idx], len(y)) + e * v[-1])

    start = time.time()
    found = _added(rows, size, n_columns, second, (idf, mean_y))
    ones, runs = found[::2], [Shifted(c, alphas, tol) for c in found[1::2]]
    spent = [(time.time() - start) / len(weightings)] * len(weightings)
    for _ in range(max_steps):
        open_ = [i for i, r in enumerate(runs) if not r.ended]
        if not open_:
            break
        start = time.time()
        products = _added(rows, size, n_columns, product, (idf, [(weightings[i], runs[i].p) for i in open_]))
        for i, ap in zip(open_, products, strict=True):
            runs[i].step(ap - ones[i] * (float(ones[i] @ runs[i].p) / n))
            spent[i] += (time.time() - start) / len(open_)
    return idf, [Path(r.x, mean_y - r.x @ (one / n), s) for r, one, s in zip(runs, ones, spent, strict=True)]


def scores(rows: DataFrame, keep: list[str], weightings: list[Weighting], idf: np.ndarray, paths: list[Path]) -> DataFrame:
    """``keep``, ``y``, ``candidate`` and ``score``: a row for each row and candidate (weighting by weighting, penalty by penalty)."""
    n_columns, each = len(weightings[0].weights), len(paths[0].intercepts)
    base = rows.select(*keep, "y", "e", "idx", "counts")
    schema = T.StructType([*base.schema.fields[:len(keep) + 1], T.StructField("scores", T.ArrayType(T.DoubleType()))])
    step = max(1, MOST_SENT // paths[0].coefficients.size)
    out = None
    for at in range(0, len(weightings), step):
        held = rows.sparkSession.sparkContext.broadcast((idf, list(zip(weightings[at:at + step], paths[at:at + step], strict=True))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            idf, models = held.value
            for batch in batches:
                y, e, row, idx, counts = _opened(batch, n_columns)
                made = []
                for w, path in models:
                    value = w.values(counts, idx, row, len(y), idf)
                    for b, c in zip(path.coefficients, path.intercepts, strict=True):
                        made.append(np.bincount(row, value * b[idx], len(y)) + e * b[-1] + c)
                table = np.stack(made, axis=1)
                ends = (np.arange(len(y) + 1) * table.shape[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(table.ravel()))], names=schema.fieldNames())

        part = base.mapInArrow(run, schema).select(*keep, "y", F.posexplode("scores").alias("candidate", "score"))
        part = part.withColumn("candidate", F.col("candidate") + at * each)
        out = part if out is None else out.unionByName(part)
    return out
