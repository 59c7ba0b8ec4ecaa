"""Documents as compact blocks of word numbers, and corpus counts of what they hold.

A block is a chunk of documents: its distinct words' 64-bit hashes and, for
each document, the numbers of its words. Blocks are a written table, so every
later step sees the same ones whatever executors are lost.

:func:`count_items` gives every block the corpus counts of its items (any
64-bit hashes computed from its words). Each block sends its distinct items
with their counts, in order and cut by hash range, so that a packed range is
one row; a range's rows meet in one group, are added up, and the totals go
back to each block in the order in which it sent the items. An item is sent
once per block however often it occurs, so a hot item is a row of each block
at most, and the ranges are even because the hashes are. The number of ranges
follows the number of blocks, so a group's size stays that of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import pieces as P
from . import texts as X

#: Bytes of text to a block.
BLOCK_BYTES = 12_000_000


def pack(a: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of pairs; the order counts."""
    h = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def draw(a: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th of independent 64-bit hashes of each value."""
    h = a + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    kind: int
    sizes: np.ndarray  # words of each document
    words: np.ndarray  # hash of each distinct word
    codes: np.ndarray  # number of the word at each place, document after document
    keys: list  # an Arrow array for each key column

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white space characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def build(docs: DataFrame, keys: list[Column], text: Column, kind: Column, label: str,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table of blocks of ``docs``; a block's documents are of one ``kind`` (a small int)."""
    source = docs.select(kind.cast("int").alias("kind"), *[k.alias(f"k{i}") for i, k in enumerate(keys)],
                         text.cast("string").alias("t"))
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in source.schema.fields[1:-1]]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), *lists,
                           *[T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "codes")]])
    names, at = schema.fieldNames(), len(source.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in X.chunks(batch, at, block_bytes):
                kinds = part.column(0).to_numpy(zero_copy_only=False)
                for k in np.unique(kinds).tolist():
                    rows = part.filter(pa.array(kinds == k))
                    found = [words_of(t) for t in rows.column(at).to_pylist()]
                    sizes = np.fromiter(map(len, found), np.uint32, len(found))
                    distinct, codes = P.numbered([w for f in found for w in f])
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
                    one = pa.array([0, len(found)], pa.int32())
                    columns = [pa.ListArray.from_arrays(one, c) for c in rows.columns[1:-1]]
                    blobs = [pa.array([pack(a)], pa.binary()) for a in (sizes, hashes, codes.astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([k], pa.int32()), *columns, *blobs], names=names)
                    number += 1

    return C.stored(source.mapInArrow(run, schema), label)


def opened(row: pa.RecordBatch | pa.Table, i: int) -> Block:
    """The block in row ``i`` of a table of blocks."""
    get = lambda c: row.column(row.schema.get_field_index(c))[i]
    keys = [get(c).values for c in row.schema.names if c[0] == "k" and c[1:].isdigit()]
    return Block(get("kind").as_py(), unpack(get("sizes").as_py(), np.uint32).astype(np.int64),
                 unpack(get("words").as_py(), np.uint64), unpack(get("codes").as_py(), np.uint32).astype(np.int64), keys)


#: From a block: its distinct items in order, and the count of each.
Items = Callable[[Block], tuple[np.ndarray, np.ndarray]]
#: From a range's distinct items and the totals of each kind: numbers to be added up over the ranges.
Stats = Callable[[np.ndarray, list[np.ndarray]], list[int]]


def count_items(blocks: DataFrame, items: Items, kinds: int, stats: Stats, label: str, free: bool = False) -> DataFrame:
    """The written table of totals: block, range, ``totals`` (one packed array for each kind), ``stats``; ``free`` as for ``stored``."""
    spark = blocks.sparkSession
    n = max(blocks.count(), C.shuffle_partitions(spark), 2)
    bits = int(n - 1).bit_length()
    sent = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("block", T.LongType()),
                         T.StructField("kind", T.IntegerType()), T.StructField("items", T.BinaryType()),
                         T.StructField("counts", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = opened(batch, i)
                found, counts = items(block)
                cuts = np.searchsorted(found, np.arange(1 << bits).astype(np.uint64) << np.uint64(64 - bits))
                ends = np.append(cuts[1:], len(found))
                full = np.flatnonzero(ends > cuts)
                rows = [(pack_sorted(found[cuts[r]:ends[r]]), pack(counts[cuts[r]:ends[r]].astype(np.uint32))) for r in full]
                number = batch.column(batch.schema.get_field_index("block"))[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()),
                    pa.array([block.kind] * len(full), pa.int32()), pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.binary())], names=sent.fieldNames())

    back = T.StructType([T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()),
                         T.StructField("totals", T.ArrayType(T.BinaryType())), T.StructField("stats", T.ArrayType(T.LongType()))])

    def add(table: pa.Table) -> pa.Table:
        each = [unpack_sorted(x.as_py()) for x in table.column("items")]
        of = np.concatenate([np.full(len(a), k) for a, k in zip(each, table.column("kind").to_pylist(), strict=True)])
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")]).astype(np.float64)
        distinct, place = np.unique(np.concatenate(each), return_inverse=True)
        totals = [np.bincount(place[of == k], counts[of == k], len(distinct)).astype(np.int64) for k in range(kinds)]
        ends = np.cumsum([len(a) for a in each]).tolist()
        mine = [place[b - len(a):b] for a, b in zip(each, ends, strict=True)]
        said = [[int(x) for x in stats(distinct, totals)]] + [None] * (len(each) - 1)
        return pa.table([table.column("block"), table.column("range"),
                         pa.array([[pack(t[m].astype(np.uint64)) for t in totals] for m in mine], pa.list_(pa.binary())),
                         pa.array(said, pa.list_(pa.int64()))], names=back.fieldNames())

    return C.stored(blocks.mapInArrow(send, sent).groupBy("range").applyInArrow(add, back), label, free)


def total_stats(totals: DataFrame, n: int) -> list[int]:
    row = totals.agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()
    return [row[i] or 0 for i in range(n)]


def with_totals(blocks: DataFrame, totals: DataFrame, kinds: int,
                use: Callable[[Block, list[np.ndarray]], pa.Table], schema: T.StructType) -> DataFrame:
    """What ``use`` makes of each block and the totals of its items, in the order of ``items``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in _arrow(schema)], names=schema.fieldNames())
        by = np.argsort(right.column("range").to_numpy())
        got = right.column("totals").to_pylist()
        sums = [np.concatenate([np.zeros(0, np.int64), *[unpack(got[i][k], np.uint64).astype(np.int64) for i in by]])
                for k in range(kinds)]
        return use(opened(left, 0), sums)

    return blocks.groupBy("block").cogroup(totals.drop("stats").groupBy("block")).applyInArrow(run, schema)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
