"""All queries of the library proper, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import graph_queries, interval_queries, report_queries, sequence_queries

FLAGSHIP = "seq_stats"
PARTS = (sequence_queries, interval_queries, graph_queries, report_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for p in PARTS for n, q in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for p in PARTS for n, s in p.ORACLE_SQL.items()}
