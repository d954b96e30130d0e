"""All queries of the library and their SQL."""

from __future__ import annotations

from . import further, markup, oracle, queries, readers

QUERIES = queries.QUERIES | readers.QUERIES | markup.QUERIES | further.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | readers.ORACLE_SQL | markup.ORACLE_SQL | further.ORACLE_SQL
