"""Running a numpy worker over the texts of a table, in bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a worker holds at once (a longer text makes a chunk of its own).
CHUNK_CHARS = 8_000_000


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, cut so that each part's texts stay within ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, text: str, keep: Sequence[str], new: T.StructType,
              make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The columns ``keep`` and the fields ``new`` made from the column ``text``.

    ``make()`` runs once a task and returns a function from a list of texts
    (None for null) to one Arrow array for each new field. No shuffle. A kept
    column named like a new one is left out.
    """
    taken = {f.name.lower() for f in new}
    kept = [c for c in keep if c.lower() not in taken]
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("t"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in chunks(batch, len(kept)):
                made = work(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)

    return source.mapInArrow(run, schema).toDF(*kept, *[f.name for f in new])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` values (0 for an empty one)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
