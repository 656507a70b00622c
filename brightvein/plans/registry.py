"""Every query of the engine by name, and the DuckDB SQL it is held against."""

from __future__ import annotations

from . import corpus_queries, ledger_queries, library_queries, path_queries, proof_queries, report_queries, retrieval_queries, structure_queries

QUERIES = corpus_queries.QUERIES | ledger_queries.QUERIES | library_queries.QUERIES | path_queries.QUERIES | proof_queries.QUERIES | report_queries.QUERIES | retrieval_queries.QUERIES | structure_queries.QUERIES
SQL = corpus_queries.SQL | ledger_queries.SQL | library_queries.SQL | path_queries.SQL | proof_queries.SQL | report_queries.SQL | retrieval_queries.SQL | structure_queries.SQL
