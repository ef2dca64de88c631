"""Joins whose sizes Spark cannot judge by itself."""
from __future__ import annotations

from pyspark.sql import DataFrame


def by_exchange(df: DataFrame) -> DataFrame:
    """The side of a join, never to be copied whole to the driver and to every task.

    Spark counts an array as one element and exploded rows as the rows they come from, so it takes a table of homographies,
    splines or spread frames to be small and would broadcast it, however many matches there are."""
    return df.hint("merge")
