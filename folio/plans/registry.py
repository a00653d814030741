"""Registered queries by operator id, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.plans import block_queries, chunking_queries, deck_queries, report_queries, retrieval_queries, stream_queries, text_queries

FLAGSHIP = "d9_hybrid_search"
_MODULES = (retrieval_queries, chunking_queries, block_queries, report_queries, text_queries, deck_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
