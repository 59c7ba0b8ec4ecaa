"""Registered queries (one per operator of the inventory) and their SQL oracles."""

from .registry import oracle_sql, queries  # noqa: F401
