"""All queries of the engine's core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarforge.plans import queries_crawl, queries_data, queries_site, queries_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_data.QUERIES, **queries_store.QUERIES, **queries_crawl.QUERIES, **queries_site.QUERIES}
ORACLE: dict[str, str] = {**queries_data.ORACLE, **queries_store.ORACLE, **queries_crawl.ORACLE, **queries_site.ORACLE}

flagship = queries_store.flagship
