"""Records in topic messages, and rows between schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.json_text import text_members, typed_members
from tidemark.functions.once import with_once


def bind_topic(messages: DataFrame, schema: StructType) -> DataFrame:
    """JSON text in ``value`` -> columns of ``schema``; other columns are kept.

    A value that cannot be read as its column's type is null; amounts that default to zero are
    zero when missing.
    """
    others = [c for c in messages.columns if c != "value"]
    members = text_members(F.col("value"), schema.fieldNames())
    bound = with_once(messages, members, "_members")
    return bound.select(*others, *typed_members(F.col("_members"), schema))


def rejected_messages(messages: DataFrame, schema: StructType, key: str, topic: str) -> DataFrame:
    """Messages whose ``key`` (and ``ts``, if the record has one) can't be read, as rows of ``topic``."""
    needed = [key, *(["ts"] if "ts" in schema.fieldNames() else [])]
    bound = bind_topic(messages.select("value", F.col("value").alias("_raw")), StructType([schema[name] for name in needed]))
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(name).isNull()
    return bound.where(missing).select(F.lit(topic).alias("topic"), F.col("_raw").alias("value"))


def copy_by_name(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``df`` that ``schema`` also has, in the schema's order and types."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]
    )


def to_messages(df: DataFrame, topic: str | None = None) -> DataFrame:
    """Rows -> JSON text in ``value``, with a ``topic`` column if one is named. Nulls are left out."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(value) if topic is None else df.select(F.lit(topic).alias("topic"), value)
