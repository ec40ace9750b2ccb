"""Checks that fail a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fail_where(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``rows``, or a failed job if ``bad`` holds for one. As a filter it runs whichever columns are read."""
    return rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
