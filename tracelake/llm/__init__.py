"""Corpus operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from tracelake.llm.entry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
