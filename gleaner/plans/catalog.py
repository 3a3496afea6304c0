"""The engine's registered queries and their SQL twins."""

from __future__ import annotations

from . import corpus, evaluation, retrieval, surfaces, walks

_PLANS = (retrieval, corpus, evaluation, walks, surfaces)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
