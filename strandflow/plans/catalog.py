"""All queries by name, with their SQL twins for DuckDB."""

from __future__ import annotations

from strandflow.plans import assignments, distances, quantities, structures

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (structures, quantities, assignments, distances):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
