"""One row per key, and key look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _top_row(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    # Spark keeps one row per key in every task before it shuffles (the group limit in the plan), so
    # a key with very many rows reaches its reducer as one row per task. A test holds it to that.
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is lowest by ``order``, nulls lowest."""
    return _top_row(df, keys, [F.col(c).asc_nulls_first() for c in order])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is highest by ``order``; without an order, any one row."""
    if not order:
        return df.dropDuplicates(list(keys))
    return _top_row(df, keys, [F.col(c).desc_nulls_last() for c in order])


def rows_with_keys(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (same column name)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def rows_without_keys(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids`` (same column name)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")
