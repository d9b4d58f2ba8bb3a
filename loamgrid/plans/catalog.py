"""All queries of the land-grading engine: name -> function, and name -> the same in SQL where SQL can express it."""

from __future__ import annotations

from . import base, clean, covers, drainage, grid, haul, ledger, scalars, streams, surface, tables  # noqa: F401  each registers its queries

QUERIES, SQL = base.QUERIES, base.SQL
