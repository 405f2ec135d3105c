"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from mapmill.plans import geo_queries, job_queries, table_queries, text_queries

QUERIES = text_queries.Q | table_queries.Q | geo_queries.Q | job_queries.Q
ORACLE_SQL = text_queries.SQL | table_queries.SQL | geo_queries.SQL | job_queries.SQL
