"""All queries by name, with the DuckDB statement that gives the same rows where SQL can express it."""

from __future__ import annotations

from tarnstone.plans import q_json, q_raster, q_rig, q_search, q_segment, q_stream, q_text  # noqa: F401
from tarnstone.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
