"""Keeping an expensive expression a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Adds ``column`` such that it is computed once per row.

    Filters on a projected column, also the not-null tests Spark derives from join keys, are pushed
    below the projection with the column's expression inlined; a JSON parse then runs once more for
    every such filter. They are not pushed below an explode, here of one element.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
