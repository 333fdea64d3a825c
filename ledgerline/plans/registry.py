"""Every registered query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, coherence, dedup, governed, grouped, imports, joins, kpis, lineage, measures, quality, rows, sales, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for part in (sales, kpis, grouped.part, joins.part, dedup.part, windows.part, rows.part, imports.part, audit.part, coherence.part, quality.part, measures.part, governed.part, lineage.part):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
