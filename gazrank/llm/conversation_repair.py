"""Repair of the turn structure of conversations, as streams.

Method: rows are dealt by conversation and sorted by turn, and ``mapInPandas`` carries the state of a
dynamic programme across the Arrow batches. The edits that make a conversation's
role initials match ``(s?(ua)+)?`` most cheaply are found from its end to its start: four
states (nothing yet, after s, after u, after a) with the cost of what follows. The best choice in each
state takes two bits, so a row's backpointers are one byte. They are written out in blocks
to a table in the shared folder, each with the sort key of its first row; the second stream,
from start to end, meets every block in front of the rows that it decides.

Scale: both streams hold one Arrow batch and at most two blocks, however many rows a
conversation has; no text is kept. Only the second one moves texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Rows to a block of backpointers.
BLOCK = 1 << 20
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
EDITS = "DIKR"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: nothing yet, after s, after u, after a. Where a user or assistant turn leads from each.
NEXT = (2, 2, 3, 2)
#: Where a kept turn leads from each state, by its initial (other, s, u, a); -1: it cannot stay.
KEPT = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
#: Cost of what is still to be inserted at the end.
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLE = {2: "user", 3: "assistant"}


def step(after: tuple, initial: int, fault: int) -> tuple[tuple, int]:
    """Costs from before a row on, in each state, and the row's backpointers; ``after`` has the costs behind it.

    Of equally cheap edits the first in ``EDITS`` is chosen, so the whole sequence is the ASCII-least one.
    """
    extra = CUT_OFF if fault == TRUNCATED else 0
    options = []
    for s in range(4):
        keep = change = None
        if fault not in (BLANK, DUPLICATE):
            to = KEPT[s][initial]
            keep = after[to] + extra if to >= 0 else None
            change = after[NEXT[s]] + REROLE + extra
        options.append([DELETE + after[s], None, keep, change])
    least = [min(o for o in row if o is not None) for row in options]
    cost = tuple(min(least[s], INSERT + least[NEXT[s]], 2 * INSERT + least[NEXT[NEXT[s]]]) for s in range(4))
    byte = 0
    for s in range(4):
        options[s][1] = INSERT + cost[NEXT[s]]
        byte |= options[s].index(cost[s]) << 2 * s
    return cost, byte


class Steps:
    """:func:`step`, remembered by the costs' differences (there are few)."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, after: tuple, initial: int, fault: int) -> tuple[tuple, int]:
        low = min(after)
        key = (after[0] - low, after[1] - low, after[2] - low, after[3] - low, initial, fault)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = step(key[:4], initial, fault)
        cost, byte = got
        return (cost[0] + low, cost[1] + low, cost[2] + low, cost[3] + low), byte


def _initial(role: str) -> int:
    return "sua".find(role[0]) + 1 if role else 0


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Sort key (k, has_turn, turn, role, h1, h2) and text; null roles and texts are one space."""
    blank = F.lit(" ")
    k = F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    base = rows.select(k.alias("k"), F.col(turn).isNotNull().alias("has_turn"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
                       F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"))
    h1, h2 = C.row_key(F.col("text"))
    return base.select("*", h1.alias("h1"), h2.alias("h2"))


KEY = ["k", "has_turn", "turn", "role", "h1", "h2"]
_COUNTS = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_BLOCKS = ("k string, has_turn boolean, turn long, role string, h1 long, h2 long, nth long, choices binary, "
           + ", ".join(f"{c} long" for c in _COUNTS))


def backpointers(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The written table of blocks of one byte a row; a conversation's first block has its counts.

    ``nth`` is the number of rows from a block's first one to the end.
    """
    seen = F.rtrim("text", F.lit(C.SPACE))
    flags = keyed.select(*KEY, F.when(seen == "", BLANK).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
                         .otherwise(0).alias("fault"))
    # One shuffle: the window's keys hold the conversation by which the rows are dealt.
    same = Window.partitionBy("k", "role", "h1", "h2").orderBy("has_turn", "turn")
    fault = F.when((F.col("copy") > 1) & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    rows = (flags.repartition(C.shuffle_partitions(keyed.sparkSession), "k").withColumn("copy", F.row_number().over(same))
            .withColumn("fault", fault)
            .sortWithinPartitions("k", *[F.desc(c) for c in (*KEY[1:], "copy")]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, now, choices, key = Steps(), None, bytearray(), None
        out: list = []

        def close(whole: bool):
            counts = [0] * len(_COUNTS)
            if whole:
                gaps = min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0
                counts = [n, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost[0]]
            out.append((*key, n, bytes(choices[::-1]), *counts))
            choices.clear()

        for batch in batches:
            for row in zip(*[batch[c].tolist() for c in [*KEY, "fault"]], strict=True):
                k, has, turn, role, _, _, fault = row
                if k != now:
                    if now is not None:
                        close(True)
                    now, cost, n, illegal, turns, after = k, AT_END, 0, 0, 0, None
                    faults, low, high = [0] * 4, None, None
                elif len(choices) == block:
                    close(False)
                initial = _initial(role)
                cost, byte = steps(cost, initial, fault)
                choices.append(byte)
                faults[fault] += 1
                if n and (initial, after) not in ((1, 2), (2, 3), (3, 2)):
                    illegal += 1
                if has:
                    high = turn if high is None else high
                    turns += turn != low
                    low = turn
                n, after, key = n + 1, initial, row[:-1]
            if out:
                yield pd.DataFrame(out, columns=_names(_BLOCKS))
                out.clear()
        if now is not None:
            close(True)
            yield pd.DataFrame(out, columns=_names(_BLOCKS))

    return C.stored(rows.select(*KEY, "fault").mapInPandas(run, _BLOCKS), "backpointers")


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(",")]


class Walk:
    """One conversation from start to end: blocks and rows go in, edited turns come out."""

    def __init__(self):
        self.state, self.blocks, self.at = 0, [], 0

    def add(self, choices: bytes):
        self.blocks.append(choices)

    def _insert(self):
        self.state = NEXT[self.state]
        return "I", ROLE[self.state], ""

    def edits(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns inserted before a row and of the row (its own also if it is deleted)."""
        byte = self.blocks[0][self.at]
        self.at += 1
        if self.at == len(self.blocks[0]):
            self.blocks.pop(0)
            self.at = 0
        while (edit := EDITS[byte >> 2 * self.state & 3]) == "I":
            yield self._insert()
        if edit == "K":
            self.state = KEPT[self.state][_initial(role)]
        elif edit == "R":
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while AT_END[self.state]:
            yield self._insert()


def _forwards(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of both tables in one order: a block in front of the first row that it decides."""
    both = blocks.select(*KEY, F.lit("").alias("text"), "nth", "choices", *_COUNTS).unionByName(
        keyed.select(*KEY, "text", F.lit(0).cast("long").alias("nth"), F.lit(None).cast("binary").alias("choices"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS]))
    return both.repartition(C.shuffle_partitions(keyed.sparkSession), "k").sortWithinPartitions(*KEY, F.desc("nth"))


def _back(k: Column, kind: T.DataType) -> Column:
    return F.when(k != "", F.substring(k, 2, 1 << 30)).cast(kind)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its id, the counts, ``audit`` (edits in order) and ``repaired_sha256``.

    ``n_rows``; ``gaps``: missing turn numbers; ``blank``, ``duplicate``, ``truncated``: rows by their first fault;
    ``illegal``: neighbours whose initials are not su, ua or au; ``cost`` of the edits; the hash is that of
    the repaired turns as ``role:text``, joined by line feeds.

    Edits: K(eep), R(erole), D(elete), I(nsert). Blank and duplicate rows must go. See :func:`repair`.
    """
    keyed = _keyed(rows, conv, turn, role, text)
    ordered = _forwards(keyed, backpointers(keyed))
    schema = "k string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []

        def take(edits):
            nonlocal line
            for edit, r, t in edits:
                audit.append(edit)
                if edit != "D":
                    digest.update((f"\n{r}:{t}" if line else f"{r}:{t}").encode("utf-8", "surrogatepass"))
                    line = True

        def close():
            take(walk.end())
            out.append((now, *counts, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for k, r, t, choices, *got in zip(*[batch[c].tolist() for c in ["k", "role", "text", "choices", *_COUNTS]], strict=True):
                if k != now:
                    if now is not None:
                        close()
                    now, walk, audit, digest, line, counts = k, Walk(), [], hashlib.sha256(), False, None
                if choices is None:
                    take(walk.edits(r, t))
                else:
                    walk.add(choices)
                    counts = counts or got
                    audit = ["".join(audit)]
            if out:
                yield pd.DataFrame(out, columns=_names(schema))
                out.clear()
        if now is not None:
            close()
            yield pd.DataFrame(out, columns=_names(schema))

    made = ordered.mapInPandas(run, schema)
    kind = rows.schema[conv].dataType
    return made.select(_back(F.col("k"), kind).alias(conv), *_COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: the conversation's id, ``pos`` (from 0), ``turn`` (null if inserted), ``edit``, ``role``, ``text``.

    * a conversation's rows are taken by turn, null turns first; ties by role and text (by its hash), so a
      repeated row stands beside its copy.
    * null roles and texts are one space; a null conversation is one like any other.
    * a conversation whose rows all go has no rows here (``report`` has one); an empty table gives an empty one.
    * a role counts by its first letter, s, u or a; any other cannot stay as it is.
    * very long texts and conversations are streamed; extra columns are not looked at.
    """
    keyed = _keyed(rows, conv, turn, role, text)
    ordered = _forwards(keyed, backpointers(keyed))
    schema = "k string, pos long, has_turn boolean, turn long, edit string, role string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pos, walk = None, 0, None

        def made(edits, has, t):
            nonlocal pos
            for edit, r, words in edits:
                if edit != "D":
                    yield now, pos, has and edit != "I", t, edit, r, words
                    pos += 1

        for batch in batches:
            out: list = []
            for k, has, t, r, words, choices in zip(*[batch[c].tolist() for c in ["k", "has_turn", "turn", "role", "text", "choices"]], strict=True):
                if k != now:
                    if now is not None:
                        out += made(walk.end(), False, 0)
                    now, pos, walk = k, 0, Walk()
                if choices is None:
                    out += made(walk.edits(r, words), has, t)
                else:
                    walk.add(choices)
            yield pd.DataFrame(out, columns=_names(schema))
        if now is not None:
            yield pd.DataFrame(list(made(walk.end(), False, 0)), columns=_names(schema))

    kind = rows.schema[conv].dataType
    return ordered.mapInPandas(run, schema).select(
        _back(F.col("k"), kind).alias(conv), "pos", F.when(F.col("has_turn"), F.col("turn")).alias("turn"), "edit", "role", "text")
