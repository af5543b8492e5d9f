"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import audio, chains, media, plans, records, timeline, transcripts

MODULES = (timeline, transcripts, plans, chains, records, media, audio)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
