"""Daily active devices: first page of a visit, first visit of a day, enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_of_date, local_date, local_hour
from tidemark.operators.dims import add_province, add_user
from tidemark.operators.keys import first_per_key, last_per_key
from tidemark.operators.topics import copy_by_name
from tidemark.schemas import DAU_INFO


def first_pages(pages: DataFrame) -> DataFrame:
    """Pages no other page led to; an empty ``last_page_id`` counts as one that did."""
    return pages.where(F.col("last_page_id").isNull())


def dedup_daily(pages: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """The earliest page per device and local day (batch form).

    ``arrival`` breaks ties of ``ts``. The streaming form is
    :func:`tidemark.streaming.state.first_of_each_day`.
    """
    dated = pages.withColumn("_day", local_date(F.col("ts")))
    return first_per_key(dated, ["mid", "_day"], ["ts", *(arrival or [])]).drop("_day")


def enrich_dau(pages: DataFrame, users: DataFrame, provinces: DataFrame, as_of=None) -> DataFrame:
    """Page records -> the DAU record: user, province, local date and hour added.

    Columns of ``pages`` that the DAU record lacks are dropped, except those named with a leading
    underscore, which are kept at the end.
    """
    kept = [c for c in pages.columns if c.startswith("_")]
    known = [f for f in DAU_INFO.fieldNames() if f in pages.columns]
    rows = pages.select(*known, *kept)
    rows = add_user(rows, users, as_of_date(as_of), "string")
    rows = add_province(rows, provinces, "province_3166_2")
    rows = rows.withColumns({"dt": local_date(F.col("ts")), "hr": local_hour(F.col("ts"))})
    return rows.select(*copy_by_name(rows, DAU_INFO).columns, *kept)


def dau_documents(dau: DataFrame, order: list[str], as_of=None) -> DataFrame:
    """DAU records as documents: one per ``(index_date, mid)``, the last by ``order``.

    ``index_date`` is the processing date, so two event days of one device that are processed on
    the same date share a document.
    """
    dated = dau.withColumn("index_date", as_of_date(as_of).cast("string"))
    return last_per_key(dated, ["index_date", "mid"], order)
