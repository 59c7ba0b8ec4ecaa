"""Query registry: ``key -> (spark, sf_dir) -> DataFrame`` plus SQL oracle text."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, object] = {}
_LOADED = False


def register(key: str, oracle=None):
    """Register a query; ``oracle`` is SQL text or a function returning it."""
    def deco(fn):
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn
    return deco


def _load():
    global _LOADED
    if _LOADED:
        return
    from . import (q_models, q_ranking, q_relational, q_splits, q_streaming,  # noqa: F401
                   q_text, q_vectors)
    _LOADED = True


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: (v() if callable(v) else v) for k, v in _ORACLES.items()}
