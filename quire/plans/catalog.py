"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import key_queries, queue_queries, state_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queue_queries.QUERIES, **text_queries.QUERIES, **key_queries.QUERIES, **state_queries.QUERIES}
ORACLES: dict[str, str] = {**queue_queries.ORACLES, **text_queries.ORACLES, **key_queries.ORACLES, **state_queries.ORACLES}
