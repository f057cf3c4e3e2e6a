"""All registered queries of the library with their DuckDB SQL."""

from __future__ import annotations

from . import compose, dedup, evaluate, flows, fusion, pages, profiles, quality, reading, relational, retrieval, solved, stored, structure, urls  # noqa: F401  (importing registers the queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
