"""Registered queries over the given tables, with the SQL each one is checked against."""
from __future__ import annotations

from passagework.registry.base import ORACLE, QUERIES
from passagework.registry import chat, chunks, evaluate, ingest, search, store, stream  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
