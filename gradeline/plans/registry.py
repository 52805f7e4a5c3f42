"""Named queries over the tables of a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import general, grading, summaries, transcripts

ALL = grading.QUERIES | transcripts.QUERIES | general.QUERIES | summaries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in ALL.items() if q.sql}
