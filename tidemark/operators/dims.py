"""Dimension tables and enrichment joins.

No join carries a broadcast hint. Spark broadcasts a dimension when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (at planning, or at run time through adaptive execution)
and otherwise shuffles both sides, splitting skewed keys at run time. Every join is a left join:
an unmatched row keeps its own columns and gets null attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import age_years
from tidemark.operators.topics import bind_topic
from tidemark.schemas import PROVINCE_DIM, PROVINCE_TABLE, USER_DIM, USER_TABLE


def _dim_rows(dims: DataFrame, table_name: str, schema) -> DataFrame:
    rows = dims.where(F.col("dim_table") == table_name.upper())
    return bind_topic(rows.select(F.col("data").alias("value")), schema)


def user_dim(dims: DataFrame) -> DataFrame:
    """``(id, gender, birthday)`` out of the latest dimension rows."""
    return _dim_rows(dims, USER_TABLE, USER_DIM)


def province_dim(dims: DataFrame) -> DataFrame:
    """``(id, name, iso_code, iso_3166_2, area_code)`` out of the latest dimension rows."""
    return _dim_rows(dims, PROVINCE_TABLE, PROVINCE_DIM)


def user_versions(changes: DataFrame, seq: str) -> DataFrame:
    """Every version of every user out of dimension changes, with the arrival column ``seq``."""
    return _versions(changes, USER_TABLE, USER_DIM, seq)


def province_versions(changes: DataFrame, seq: str) -> DataFrame:
    return _versions(changes, PROVINCE_TABLE, PROVINCE_DIM, seq)


def _versions(changes: DataFrame, table_name: str, schema, seq: str) -> DataFrame:
    rows = changes.where(F.col("dim_table") == table_name.upper())
    return bind_topic(rows.select(seq, F.col("data").alias("value")), schema)


def _look_up(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    # Dimension ids are text; a numeric key is turned into text, never the id into a number.
    keyed = dim.withColumnRenamed("id", "_dim_id")
    return df.join(keyed, F.col(key).cast("string") == F.col("_dim_id"), "left").drop("_dim_id")


def add_user(df: DataFrame, users: DataFrame, as_of: Column, age_type: str) -> DataFrame:
    """Adds ``user_gender`` and ``user_age`` (completed years at ``as_of``) by ``user_id``."""
    attributes = users.select(
        "id",
        F.col("gender").alias("user_gender"),
        F.col("birthday").alias("_birthday"),
    )
    age = age_years(F.col("_birthday"), as_of).cast(age_type)
    return _look_up(df, attributes, "user_id").withColumn("user_age", age).drop("_birthday")


def add_province(df: DataFrame, provinces: DataFrame, iso_3166_2: str) -> DataFrame:
    """Adds the province attributes by ``province_id``; the ISO 3166-2 column's name differs by
    result table and is given by the caller."""
    attributes = provinces.select(
        "id",
        F.col("name").alias("province_name"),
        F.col("iso_code").alias("province_iso_code"),
        F.col("iso_3166_2").alias(iso_3166_2),
        F.col("area_code").alias("province_area_code"),
    )
    return _look_up(df, attributes, "province_id")
