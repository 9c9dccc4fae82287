"""All queries of the core, by importing their modules."""

from kosha.plans import audit_queries, corpus_queries, corpus_tables, entity_queries, more_queries, ranking_queries, retrieval_queries, study_queries, text_queries  # noqa: F401
from kosha.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
