"""The query catalogue: name -> query, and name -> oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigate.operators import changes, documents, gate_queries, hashes, memory, packs, planted_gates, quality, records, relational, review, services, spans, suites, term_search, text_queries, versions
from lexigate.plans import audit
from lexigate.streaming import chains, events

_MODULES = (relational, quality, review, planted_gates, term_search, records, gate_queries, documents, text_queries, changes, hashes, spans, suites, packs, memory, versions, services, audit, events, chains)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
