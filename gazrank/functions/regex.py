"""Regex dialect conversion: Python ``re`` -> Java (Spark) and RE2 (DuckDB).

Python's ``\\w``/``\\W``/``\\s``/``\\d`` are Unicode-aware; Java's are ASCII
unless flags are set, and ``(?U)`` differs on marks and some numbers.  The
shorthands are therefore rewritten into explicit Unicode classes that mean
the same thing in all three engines.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
# Characters Python's str.split() / \s treat as whitespace.
WS_CHARS = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = "[" + WS_CHARS + "]"
DIGIT = r"\p{Nd}"

_SHORTHAND = {"w": WORD, "W": NON_WORD, "s": WS, "d": DIGIT}


def _rewrite(pattern: str) -> str:
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if not in_class and nxt in _SHORTHAND:
                out.append(_SHORTHAND[nxt])
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """Java pattern with Python semantics (``(?d)``: only ``\\n`` ends a line)."""
    flags = "(?diu)" if ignore_case else "(?d)"
    return flags + _rewrite(pattern)


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _rewrite(pattern)


def java_replacement(repl: str) -> str:
    """Python replacement (``\\1``) -> Java replacement (``$1``)."""
    repl = repl.replace("$", "\\$")
    return re.sub(r"\\(\d)", r"$\1", repl)


def re2_replacement(repl: str) -> str:
    return repl


def split_group(pattern: str) -> tuple[str, str, str]:
    """Split ``A(G)B`` around its single capturing group."""
    depth = 0
    start = end = None
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "(":
            capturing = not pattern.startswith("(?", i)
            if capturing and start is None:
                start = i
                depth = 1
            elif start is not None and end is None:
                depth += 1
        elif ch == ")" and start is not None and end is None:
            depth -= 1
            if depth == 0:
                end = i
        i += 1
    if start is None or end is None:
        raise ValueError(f"no capturing group in {pattern!r}")
    return pattern[:start], pattern[start + 1:end], pattern[end + 1:]
