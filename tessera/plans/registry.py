"""All queries of the library, by name, with the SQL that says the same."""

from __future__ import annotations

from tessera.plans import text_queries, upkeep_queries

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
QUERIES, ORACLES = text_queries.QUERIES | upkeep_queries.QUERIES, text_queries.ORACLES | upkeep_queries.ORACLES
FLAGSHIP = "hybrid_search"
