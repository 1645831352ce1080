"""All registered queries; importing this module registers them."""

from paperloom.plans import assembly_queries, graph_queries, map_queries, more_queries, paper_queries, rule_queries, scalar_queries, seed_queries, source_queries, store_queries, text_queries, usage_queries  # noqa: F401
from paperloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
