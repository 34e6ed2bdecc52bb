"""All registered core queries with their oracle SQL."""

from __future__ import annotations

from . import causal, components, evaluation, metrics, preprocess, reports

PARTS = (preprocess, metrics, components, causal, evaluation, reports)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
