"""The jobs in batch form, over whole inputs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changes as ch
from tidemark.operators.dau import dau_documents, dedup_daily, enrich_dau, first_pages
from tidemark.operators.logs import parse_log, split_pages
from tidemark.operators.orders import enrich_orders
from tidemark.operators.topics import bind_topic
from tidemark.schemas import ORDER_DETAIL, ORDER_INFO


def active_devices(lines: DataFrame, seq: str) -> DataFrame:
    """Log lines -> the first page of each device and day. ``seq`` names the arrival column, which
    comes out as ``_seq``."""
    pages = split_pages(parse_log(lines)).withColumnRenamed(seq, "_seq")
    return dedup_daily(first_pages(pages), ["_seq"])


def enriched_devices(lines, seq: str, users, provinces, as_of=None) -> DataFrame:
    return enrich_dau(active_devices(lines, seq), users, provinces, as_of)


def dau_index(lines, seq: str, users, provinces, as_of=None, index_as_of=None) -> DataFrame:
    """DAU documents. ``index_as_of`` is the processing date that names the index, ``as_of`` the one
    ages are counted to; they differ only when a past run is reproduced."""
    enriched = enriched_devices(lines, seq, users, provinces, as_of)
    day = as_of if index_as_of is None else index_as_of
    return dau_documents(enriched, ["ts", "_seq"], day).drop("_seq")


def bound_headers(messages: DataFrame) -> DataFrame:
    return bind_topic(messages, ORDER_INFO)


def bound_lines(messages: DataFrame) -> DataFrame:
    return bind_topic(messages, ORDER_DETAIL)


def enriched_headers(messages, users, provinces, as_of=None) -> DataFrame:
    return enrich_orders(bound_headers(messages), users, provinces, as_of)


def stored_changes(lines: DataFrame, path: str) -> DataFrame:
    """Changes that carry a row, written to a folder all executors share: what reads them more than once parses them once."""
    changes = ch.row_changes(ch.parse_changes(lines))
    changes.write.parquet(path)
    return lines.sparkSession.read.schema(changes.schema).parquet(path)


def topic_messages(lines: DataFrame, fact_tables: DataFrame) -> DataFrame:
    """Change-log lines -> messages of all fact topics."""
    return ch.fact_messages(ch.row_changes(ch.parse_changes(lines)), fact_tables)


def dimension_rows(lines, fact_tables, apply_deletes: bool = False) -> DataFrame:
    """Change-log lines with ``seq`` -> the latest row of every dimension key."""
    changes = ch.dim_changes(ch.row_changes(ch.parse_changes(lines)), fact_tables)
    return ch.latest_dims(changes, ["seq"], apply_deletes)


def on_topic(messages: DataFrame, topic: str) -> DataFrame:
    return messages.where(F.col("topic") == topic).select("value")
