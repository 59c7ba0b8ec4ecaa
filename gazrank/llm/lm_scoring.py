"""Language-model scores by deleted interpolation.

Method: maximum-likelihood estimates of bigrams, unigrams and the uniform
distribution are mixed with weights that depend on how often the context (the
word before) occurs, in buckets by powers of two. The weights are learned by
expectation-maximisation on held-out counts: of the training documents a tenth
(remainder ``TUNE``) is set aside, the estimates come from the others, and the
weights make the set-aside tokens most likely. The final estimates come from
all training documents.

Scale: the counts are exact, over all words and pairs (``blocks.count_items``);
they grow with the corpus and never meet in one place. EM needs of a held-out
token only its bucket and how the three estimates relate, so tokens are
gathered in a histogram of these (log ratios to ``STEP``), whose size does not
depend on the corpus; that, four totals and the weights are all the driver sees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import common as C

HELD_OUT, TUNE, FOLDS = 0, 9, 10
STEP = 0.05
ROUNDS = 200
#: Hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)
_REST, _TUNE, _JUDGED = 0, 1, 2


def _sequence(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, and the token before each: numbers into words + (END, START)."""
    size = b.sizes + 1
    ends = np.cumsum(size) - 1
    now = np.empty(int(size.sum()), np.int64)
    inside = np.ones(len(now), bool)
    inside[ends] = False
    now[inside], now[ends] = b.codes, len(b.words)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - b.sizes] = len(b.words) + 1
    return now, before, size


def _found(b: B.Block):
    """Items in order (hashes: odd for tokens, even for pairs) and where tokens and pairs of the block are among them."""
    now, before, size = _sequence(b)
    hashes = np.concatenate([b.words, [END, START]])
    n = len(hashes)
    pairs, pair_of = np.unique(before * n + now, return_inverse=True)
    single = B.mix(hashes[:-1], np.uint64(1)) | np.uint64(1)
    double = B.mix(B.mix(hashes[pairs // n], np.uint64(2)), hashes[pairs % n]) & ~np.uint64(1)
    items, place = np.unique(np.concatenate([single, double]), return_inverse=True)
    return now, before, size, items, place[:n - 1], place[n - 1:], pair_of


def _items(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    now, _, _, items, single, double, pair_of = _found(b)
    counts = np.zeros(len(items), np.int64)
    if b.kind != _JUDGED:
        np.add.at(counts, single, np.bincount(now, minlength=len(single)))
        np.add.at(counts, double, np.bincount(pair_of, minlength=len(double)))
    return items, counts


def _stats(items: np.ndarray, totals: list[np.ndarray]) -> list[int]:
    """Tokens and distinct tokens: without and with the set-aside documents."""
    single = (items & np.uint64(1)).astype(bool)
    rest, train = totals[_REST][single], (totals[_REST] + totals[_TUNE])[single]
    return [rest.sum(), (rest > 0).sum(), train.sum(), (train > 0).sum()]


def _estimates(b: B.Block, counts: np.ndarray, tokens: int, distinct: int):
    """Of each token: bucket of its context, bigram, unigram and uniform estimate, its own count; and text sizes."""
    now, before, size, _, single, double, pair_of = _found(b)
    own = np.append(counts[single], 0)
    own[-1] = own[-2]  # a text begins as often as one ends
    context = own[before]
    two = counts[double][pair_of] / np.maximum(context, 1)
    one = own[now] / max(tokens, 1)
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)
    return bucket, two, one, 1.0 / (distinct + 1), own[now], size


_HISTOGRAM = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "two", "one", "n")])
_NONE = -10**6


def learn(cells: np.ndarray) -> dict[int, np.ndarray]:
    """Weights (bigram, unigram, uniform) of each bucket, and of all together under -1, by EM.

    ``cells``: rows of bucket, ``two``, ``one`` (log ratio to the uniform estimate in steps, or ``_NONE`` for 0), number.
    """
    def fit(part: np.ndarray, start: np.ndarray) -> np.ndarray:
        ratios = np.stack([np.where(part[:, i] == _NONE, 0.0, np.exp(part[:, i] * STEP)) for i in (1, 2)]
                          + [np.ones(len(part))], axis=1)
        weights = start
        for _ in range(ROUNDS):
            share = ratios * weights
            share /= share.sum(axis=1, keepdims=True)
            # One token's worth of the start weights keeps every weight above 0.
            new = (share * part[:, 3:]).sum(axis=0) + start
            new /= new.sum()
            if np.abs(new - weights).max() < 1e-9:
                break
            weights = new
        return weights

    everywhere = fit(cells, np.full(3, 1 / 3)) if len(cells) else np.full(3, 1 / 3)
    return {-1: everywhere} | {int(k): fit(cells[cells[:, 0] == k], everywhere) for k in np.unique(cells[:, 0])}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32 of the id as text has a remainder
    other than 0 by 10 (a null id counts as the empty text, so it is held out).

    * null or empty text: one token, the end.
    * repeated rows count and are scored each; equal texts get equal scores.
    * without any training token the estimates are uniform over one token.
    * an empty table gives an empty table; extra columns are not looked at.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    kind = F.when(fold == HELD_OUT, _JUDGED).when(fold == TUNE, _TUNE).otherwise(_REST)
    blocks = B.build(docs, [F.col(id_col)], F.col(text), kind, "lm-blocks")
    totals = B.count_items(blocks, _items, 3, _stats, "lm-totals")
    rest_tokens, rest_distinct, tokens, distinct = B.total_stats(totals, 4)

    def histogram(b: B.Block, counts: list[np.ndarray]) -> pa.Table:
        bucket, two, one, uniform, _, _ = _estimates(b, counts[_REST], rest_tokens, rest_distinct)
        with np.errstate(divide="ignore"):
            steps = [np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300) / uniform) / STEP), _NONE).astype(np.int64)
                     for p in (two, one)]
        cells, n = np.unique(np.stack([bucket, *steps]), axis=1, return_counts=True)
        return pa.table([*cells, n], names=_HISTOGRAM.fieldNames())

    cells = (B.with_totals(blocks.filter(F.col("kind") == _TUNE), totals, 3, histogram, _HISTOGRAM)
             .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect())
    weights = learn(np.array([tuple(r) for r in cells], np.float64).reshape(-1, 4))
    table = np.array([weights.get(k, weights[-1]) for k in range(65)])
    table[0, 1:] += table[0, 0] / 2  # a context that never occurs has no bigram estimate
    table[0, 0] = 0.0

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
                          + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
                          + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])

    def judge(b: B.Block, counts: list[np.ndarray]) -> pa.Table:
        bucket, two, one, uniform, own, size = _estimates(b, counts[_REST] + counts[_TUNE], tokens, distinct)
        p = table[bucket]
        mixed = p[:, 0] * two + p[:, 1] * one + p[:, 2] * uniform
        first = np.cumsum(size) - size
        base = np.log10((own + 0.1) / (tokens + 0.1 * (distinct + 1)))
        n = len(size)
        return pa.table([b.keys[0], pa.array(np.full(n, b.kind == _JUDGED)), pa.array(size),
                         pa.array(np.add.reduceat(own > 0, first, dtype=np.int64)), pa.array(np.full(n, tokens)),
                         pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(mixed), first))],
                        names=schema.fieldNames())

    return B.with_totals(blocks, totals, 3, judge, schema)
