"""Near-duplicate documents by consistent weighted sampling.

Method: a document is its set of word 5-grams with weights tf x idf (idf from
exact corpus counts). Improved consistent weighted sampling draws ``BANDS x
ROWS`` samples, equal for two documents with the probability of their weighted Jaccard
similarity; documents that agree in all samples of a band meet in a bucket.
Pairs are verified by the exact weighted Jaccard similarity, and the verified
links' connected components are the classes.

The idf of a large group's 5-grams falls with the group, that of an edit stays: the
larger the group, the less alike its copies by these weights. With ``sets`` the distinct 5-grams
count too, each as one: min-hashes make as many further bands, and a
pair is a link if either similarity reaches the threshold.

Which pairs: texts of equal words are one node from the start. A bucket does
not give all its pairs. First every member is held against the bucket's pivot,
the member that has the most company over all its buckets (the original of a
group of edited copies). Then every member that is not in its pivot's class
is held against the members of other classes. So no pair of a bucket that could join two
classes is left out. The buckets of min-hashes give their pivots' pairs only: edited copies of one
text often meet there without a link, so that all pairs of them would grow with the square of the group. Two exact bounds save work without losing a pair: a
document whose weight in 5-grams of two documents or more is under the
threshold's share has no partner and is not sampled, and a pair whose weights
rule the threshold out is not verified.

Scale: corpus counts are those of ``blocks``. Buckets hold 16-byte nodes;
only sampled documents' vectors are kept, and they move once for each
verified pair. Joins on hot buckets and pivots are left to the adaptive skew join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import common as C
from . import texts as X
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
#: Bytes of text to a block; a task holds the weighted 5-grams of one block.
BLOCK_BYTES = 6_000_000


def shingles(b: B.Block, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of ``n`` words; a shorter text's words are one run."""
    word = b.words[b.codes]
    total = max(len(word) - n + 1, 0)
    h = word[:total]
    for i in range(1, n):
        h = B.mix(h, word[i:total + i])
    owner = np.repeat(np.arange(len(b.sizes)), b.sizes)
    left = np.repeat(np.cumsum(b.sizes), b.sizes) - np.arange(len(word))
    at = np.flatnonzero(left[:total] >= n)
    short = np.flatnonzero((b.sizes > 0) & (b.sizes < n))
    one = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short.tolist()):
        run = word[b.starts[d]:b.starts[d] + b.sizes[d]]
        one[i:i + 1] = run[:1]
        for w in run[1:]:
            one[i:i + 1] = B.mix(one[i:i + 1], w)
    doc = np.concatenate([owner[:total][at], short])
    return doc, np.concatenate([h[at], one])


def weighted(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and term frequency of its distinct shingles, in order."""
    doc, h = shingles(b)
    by = np.lexsort([h, doc])
    doc, h = doc[by], h[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def _items(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(weighted(b)[1], return_counts=True)


def samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples (hashes) of each set; a set begins at each of ``first``."""
    log_w = np.log(weight)
    size = np.diff(np.append(first, len(h)))
    out = np.empty((n, len(first)), np.uint64)
    unit = lambda x, bits: ((x & np.uint64((1 << bits) - 1)).astype(np.float64) + 0.5) / (1 << bits)
    for k in range(n):
        x, y = (B.draw(h, 2 * k + i) for i in (1, 2))
        r = -np.log(unit(x, 32) * unit(x >> np.uint64(32), 32))
        c = -np.log(unit(y, 24) * unit(y >> np.uint64(24), 24))
        shift = unit(y >> np.uint64(48), 16)
        t = np.floor(log_w / r + shift)
        a = np.log(c) - r * (t - shift) - r
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), size))
        # Equal values: the first shingle by hash.
        pick = least[np.searchsorted(least, first)]
        out[k] = B.mix(h[pick], t[pick].astype(np.int64).view(np.uint64))
    return out


def minima(h: np.ndarray, first: np.ndarray, n: int, start: int) -> np.ndarray:
    """``n`` min-hashes of each set, by the hash functions from number ``start`` on."""
    return np.stack([np.minimum.reduceat(B.draw(h, start + k), first) for k in range(n)])


def fingerprints(b: B.Block) -> list[bytes]:
    word = b.words[b.codes]
    return [hashlib.blake2b(word[s:s + n].tobytes(), digest_size=16).digest()
            for s, n in zip(b.starts.tolist(), b.sizes.tolist(), strict=True)]


def possible(u1: Column, w1: Column, u2: Column, w2: Column, threshold: float) -> Column:
    """Whether two weights, and the parts of them that others have too, allow the threshold."""
    both = F.least(u1, u2)
    return both >= (threshold - 1e-9) * (w1 + w2 - both)


def verify(pairs: DataFrame, nodes: DataFrame, threshold: float, sets: bool = False) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold, or with ``sets`` that of their distinct 5-grams."""
    fields = ("items", "weights", "total", "size")
    side = lambda n: nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in fields])
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    columns = ["a", "b", *[f"{c}_{n}" for n in "ab" for c in fields]]
    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in ("a", "b")])

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            ok = []
            for _, _, ia, wa, ta, na, ib, wb, tb, nb in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                _, x, y = np.intersect1d(B.unpack_sorted(ia), B.unpack_sorted(ib), assume_unique=True, return_indices=True)
                both = np.minimum(B.unpack(wa, np.float64)[x], B.unpack(wb, np.float64)[y]).sum()
                ok.append(both >= (threshold - 1e-9) * (ta + tb - both)
                          or sets and len(x) >= (threshold - 1e-9) * (na + nb - len(x)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return joined.select(*columns).mapInArrow(run, schema)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
            bands: int = BANDS, rows: int = ROWS, sets: bool = False) -> DataFrame:
    """For each row of ``docs`` its keys ``rk1, rk2``, its id, ``class_id`` and ``leads``.

    The class id is the smallest id of the class; the row with it leads (of
    several, the first by row key; rows with equal id and text lead together).

    * texts without words (null, empty, blank) are copies of each other; texts
      of fewer than five words match texts with the same words only.
    * words are compared with A-Z in lower case; white space does not count.
    * a null id comes after all others; a class of null ids only has a null class id.
    * a similarity equal to the threshold is a link; with ``sets`` either similarity makes one.
    * an empty table gives an empty table; extra columns are not looked at.
    """
    blocks = B.build(docs, [F.col(id_col), *C.row_key(F.col(id_col), F.col(text))], F.col(text), F.lit(0), "dup-blocks",
                     BLOCK_BYTES)
    total = blocks.agg(F.sum(F.size("k0"))).first()[0] or 0
    counts = B.count_items(blocks, _items, 1, lambda items, totals: [], "dup-counts", free=True)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("rk1", T.LongType()), T.StructField("rk2", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("items", T.BinaryType()), T.StructField("weights", T.BinaryType()),
        T.StructField("total", T.DoubleType()), T.StructField("shared", T.DoubleType()),
        T.StructField("size", T.LongType()), T.StructField("common", T.LongType())])

    def sign(b: B.Block, totals: list[np.ndarray]) -> pa.Table:
        doc, h, tf = weighted(b)
        n = len(b.sizes)
        df = totals[0][np.searchsorted(np.unique(h), h)]
        weight = tf * (np.log((1 + total) / (1 + df)) + 1)
        whole, shared = np.bincount(doc, weight, n), np.bincount(doc, weight * (df > 1), n)
        size, common = np.bincount(doc, minlength=n), np.bincount(doc[df > 1], minlength=n)
        node = fingerprints(b)
        first_of = {}
        for i, x in enumerate(node):
            first_of.setdefault(x, i)
        chosen = np.zeros(n, bool)
        chosen[list(first_of.values())] = True
        enough = shared >= (threshold - 1e-9) * whole
        chosen &= (whole > 0) & (enough | (common >= (threshold - 1e-9) * size) if sets else enough)
        inside = chosen[doc]
        d, hh, ww, dd = doc[inside], h[inside], weight[inside], df[inside]
        at = np.flatnonzero(chosen)
        first = np.searchsorted(d, at)
        last = np.searchsorted(d, at, "right")
        keys: list = [None] * n
        vectors: list = [(None, None)] * n
        if len(at):
            drawn = samples(hh, ww, first, bands * rows)
            if sets:
                drawn = np.concatenate([drawn, minima(hh, first, bands * rows, 2 * bands * rows + 1)])
            sign = [np.full(len(at), np.uint64(i)) for i in range(len(drawn) // rows)]
            for i in range(len(sign)):
                for s in drawn[i * rows:(i + 1) * rows]:
                    sign[i] = B.mix(sign[i], s)
            table = np.stack(sign, axis=1).view(np.int64)
            for j, i in enumerate(at.tolist()):
                several = dd[first[j]:last[j]] > 1
                keys[i] = table[j].tolist()
                vectors[i] = (B.pack_sorted(hh[first[j]:last[j]][several]), B.pack(ww[first[j]:last[j]][several]))
        return pa.table([*b.keys, pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                         pa.array([v[0] for v in vectors], pa.binary()), pa.array([v[1] for v in vectors], pa.binary()),
                         pa.array(whole), pa.array(shared), pa.array(size, pa.int64()), pa.array(common, pa.int64())], names=schema.fieldNames())

    signed = C.stored(B.with_totals(blocks, counts, 1, sign, schema), "dup-signed", free=True)
    for done in (blocks, counts):  # nothing reads them from here on
        C.drop_stored(done)
    nodes = C.stored(signed.filter("bands is not null").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("bands", "items", "weights", "total", "shared", "size", "common")]), "dup-nodes")
    links = _links(nodes, threshold, bands, sets)
    found = components(links)
    leader = F.struct(F.col("id").isNull().alias("none"), "id", "rk1", "rk2")
    groups = signed.groupBy("node").agg(F.min(leader).alias("leader")).join(found, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "leader")
    first = groups.groupBy("root").agg(F.min("leader").alias("leader"))
    of_node = groups.select("node", "root").join(first, "root").select("node", "leader")
    return signed.select("id", "rk1", "rk2", "node").join(C.stored(of_node, "dup-classes"), "node").select(
        "rk1", "rk2", F.col("id").alias(id_col), F.col("leader.id").alias("class_id"),
        ((F.col("rk1") == F.col("leader.rk1")) & (F.col("rk2") == F.col("leader.rk2"))).alias("leads"))


def _links(nodes: DataFrame, threshold: float, bands: int, sets: bool) -> DataFrame:
    sums = ("total", "shared", "size", "common")
    member = nodes.select("node", *sums, "bands", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    member = C.stored(member.join(sizes, "bucket"), "dup-members")
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    pivot = member.join(company, "node").groupBy("bucket").agg(
        F.max(F.struct("company", "node", *sums)).alias("p"))

    fits = lambda part, whole: possible(*[F.col(f"{n}.{c}") for n in ("m", "o") for c in (part, whole)], threshold)
    weighed, either = fits("shared", "total"), fits("shared", "total") | (F.lit(sets) & fits("common", "size"))
    # The pivot of each row's bucket stays with the row: the second step needs it again.
    member = C.stored(member.join(pivot.select("bucket", "p"), "bucket").select(
        "bucket", "band", F.struct("node", *sums, "bands").alias("m"), "p"), "dup-pivots")
    ordered = [F.least("m.node", "o.node").alias("a"), F.greatest("m.node", "o.node").alias("b")]
    tested = C.stored(member.withColumnRenamed("p", "o").filter((F.col("m.node") != F.col("o.node")) & either)
                      .select(*ordered).distinct(), "dup-pairs")
    links = C.stored(verify(tested, nodes, threshold, sets), "dup-links")
    # Members outside their pivot's class, against all members of other classes: in the weighted samples' buckets.
    found = components(links)
    classed = (member.filter(F.col("band") < bands).select("bucket", "band", "m", F.col("p.node").alias("pivot"), F.col("m.node").alias("node"))
               .join(found, "node", "left").select("bucket", "band", "m", "pivot", F.coalesce("root", "node").alias("class"))
               .join(found.withColumnsRenamed({"node": "pivot", "root": "proot"}), "pivot", "left")
               .withColumn("outside", F.coalesce("proot", "pivot") != F.col("class")))
    classed = C.stored(classed, "dup-classed")
    mixed = classed.filter("outside").select("bucket", "band", "m", F.col("class").alias("mclass"))
    others = (classed.join(mixed.select("bucket").distinct(), "bucket", "left_semi")
              .select("bucket", F.col("m").alias("o"), F.col("class").alias("oclass")))
    # A pair that shares several buckets comes from the first of them only.
    fresh = F.forall(F.zip_with(F.slice("m.bands", F.lit(1), F.col("band")), F.slice("o.bands", F.lit(1), F.col("band")),
                                lambda x, y: x != y), lambda x: x)
    rest = (mixed.join(others, (mixed["bucket"] == others["bucket"]) & (F.col("mclass") != F.col("oclass")) & weighed & fresh)
            .select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"))
    return links.unionByName(C.stored(verify(rest, nodes, threshold, sets), "dup-links"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each class: the leader's (of rows with equal id and text, one)."""
    lead = classes(docs, id_col, text, **settings).filter("leads").select("rk1", "rk2").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *C.row_key(F.col(id_col), F.col(text)))
    return (rows.join(lead, ["rk1", "rk2"], "left_semi")
            .groupBy("rk1", "rk2").agg(F.first("row").alias("row")).select("row.*"))
