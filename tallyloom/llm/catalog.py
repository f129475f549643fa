"""All queries of the subpackage."""

from tallyloom.llm import corpus_queries, queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
__all__ = ["ORACLES", "QUERIES", "corpus_queries"]
