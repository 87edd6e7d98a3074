"""All core queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from granary.plans import queries_corpus, queries_more, queries_refs, queries_retrieval, queries_structure, queries_text, queries_values

MODULES = (queries_values, queries_retrieval, queries_text, queries_corpus, queries_structure, queries_more, queries_refs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
