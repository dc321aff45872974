"""All core queries and their SQL."""

from __future__ import annotations

from mossline.plans import core_queries, reference_queries

FLAGSHIP = "rrf_penalized"
QUERIES = core_queries.QUERIES | reference_queries.QUERIES
ORACLES = core_queries.ORACLES | reference_queries.ORACLES
