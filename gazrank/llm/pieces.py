"""A SentencePiece vocabulary as plain tables, and the units that texts split into.

The model file is read on the driver (its path is a parameter); the tables are
of its size and go to the executors with the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from .texts import ragged, sums

MARK = "▁"
UNK_PENALTY = 10.0


@dataclass
class Pieces:
    """``text``, ``score``: the ordinary pieces by id (None elsewhere). ``byte``: id of each byte, or -1."""

    text: list
    score: list
    byte: list
    unk: int
    unigram: bool
    long: str = field(default="")  # characters that occur in pieces of several
    across: bool = False  # some piece goes on over the start of a word

    def __post_init__(self):
        several = [p for p in self.text if p and len(p) > 1]
        self.long = "".join(sorted({c for p in several for c in p}))
        self.across = any(MARK in p.lstrip(MARK) for p in several)

    @property
    def fallback(self) -> bool:
        return min(self.byte) >= 0

    def unit_pattern(self) -> str:
        """Splits a text where no piece can reach over: exact, whatever the scores are."""
        inner = "".join(map(re.escape, self.long.replace(MARK, "")))
        if self.across or not inner:
            return f"[{re.escape(self.long)}]+|." if self.long else "."
        return f"{MARK}*[{inner}]+|{MARK}+|."


def load(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
    byte = [-1] * 256
    for i in ids:
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
    return Pieces([sp.id_to_piece(i) if ok else None for i, ok in zip(ids, plain, strict=True)],
                  [sp.get_score(i) if ok else None for i, ok in zip(ids, plain, strict=True)],
                  byte, sp.unk_id(), is_unigram(path))


def _fields(data: bytes) -> Iterable[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: object = number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            value = data[at:at + n]
            at += n
        yield key >> 3, kind, value


def is_unigram(path: str) -> bool:
    """The model type that the file states (its default is unigram)."""
    with open(path, "rb") as f:
        trainer = [v for n, _, v in _fields(f.read()) if n == 2]
    return [v for t in trainer for n, _, v in _fields(t) if n == 3] in ([], [1])


def normal(text: str | None) -> str:
    """Spaces as marks and a mark in front, as the vocabulary has them."""
    return MARK + text.replace(" ", MARK) if text else ""


def numbered(items: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct strings in their order, and the number of each item's."""
    index = {u: i for i, u in enumerate(dict.fromkeys(items))}
    return list(index), np.fromiter(map(index.__getitem__, items), np.int64, len(items))


def split(texts: list, pattern: re.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units, the unit of each place in the texts, and the number of units of each text.

    Texts are first cut at single spaces, where a unit ends in any case if no
    piece goes over the start of a word; only distinct parts meet the pattern.
    """
    parts: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    cut = pattern.pattern.startswith(f"{MARK}*")
    for i, t in enumerate(texts):
        if t:
            if cut and "  " not in t and MARK not in t and t[0] != " ":
                got = (MARK + t.replace(" ", " " + MARK)).split(" ")
            else:
                got = pattern.findall(normal(t))
            counts[i] = len(got)
            parts += got
    coarse, places = numbered(parts)
    fine = [pattern.findall(c) for c in coarse]
    size = np.fromiter(map(len, fine), np.int64, len(fine))
    units, inner = numbered([u for f in fine for u in f])
    start = np.cumsum(size) - size
    return units, inner[ragged(start[places], size[places])], sums(size[places], counts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
