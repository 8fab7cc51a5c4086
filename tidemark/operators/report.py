"""The daily activity report over DAU documents partitioned by ``index_date``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import as_of_date, previous_day
from tidemark.schemas import HOUR_BUCKETS


def dau_total(docs: DataFrame, dt: str) -> DataFrame:
    """``dauTotal``: the number of documents of one day, 0 if the day has none."""
    return docs.where(F.col("index_date") == dt).agg(F.count(F.lit(1)).alias("dauTotal"))


def dau_by_hour(docs: DataFrame, dt: str) -> DataFrame:
    """``(hr, cnt)`` of one day: the hours with most devices, ties by hour."""
    counts = docs.where((F.col("index_date") == dt) & F.col("hr").isNotNull()).groupBy("hr").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return counts.orderBy(F.desc("cnt"), "hr").limit(HOUR_BUCKETS)


def _hour_counts(docs: DataFrame) -> DataFrame:
    """``(index_date, hr, cnt, rank)``; counting before ranking leaves a handful of rows a day."""
    counts = docs.groupBy("index_date", "hr").agg(F.count(F.lit(1)).alias("cnt"))
    by_count = Window.partitionBy("index_date").orderBy(
        F.col("hr").isNull(), F.desc("cnt"), F.col("hr")
    )
    return counts.withColumn("rank", F.row_number().over(by_count))


def dau_by_hour_each_day(docs: DataFrame) -> DataFrame:
    """``(index_date, hr, cnt)``: :func:`dau_by_hour` for every day at once."""
    top = (F.col("rank") <= HOUR_BUCKETS) & F.col("hr").isNotNull()
    return _hour_counts(docs).where(top).select("index_date", "hr", "cnt")


def dau_realtime(docs: DataFrame, dt: str, as_of=None) -> DataFrame:
    """One row ``(dauTotal, dauTd, dauYd)``: total and hourly counts of ``dt``, and hourly counts
    of the day before ``as_of`` -- before *today*, whatever ``dt`` is.

    A day without documents has total 0 and a null map. Both days are read in one pass.
    """
    yesterday = previous_day(as_of_date(as_of)).cast("string")
    counts = _hour_counts(docs.where((F.col("index_date") == dt) | (F.col("index_date") == yesterday)))

    def total(is_day: Column) -> Column:
        return F.coalesce(F.sum(F.when(is_day, F.col("cnt"))), F.lit(0))

    def hours(is_day: Column) -> Column:
        top = is_day & F.col("hr").isNotNull() & (F.col("rank") <= HOUR_BUCKETS)
        entries = F.collect_list(F.when(top, F.struct("hr", "cnt")))
        return F.when(total(is_day) > 0, F.map_from_entries(entries))

    is_today, is_yesterday = F.col("index_date") == dt, F.col("index_date") == yesterday
    return counts.agg(
        total(is_today).alias("dauTotal"),
        hours(is_today).alias("dauTd"),
        hours(is_yesterday).alias("dauYd"),
    )


def unpack_realtime(report: DataFrame) -> DataFrame:
    """The report as rows ``(part, hr, cnt)``; a null map gives one row with null ``hr``."""

    def row(part: str, hr: Column, cnt: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), hr.cast("string").alias("hr"), cnt.cast("bigint").alias("cnt")
        )

    def hours(part: str) -> Column:
        rows = F.transform(F.map_entries(part), lambda e: row(part, e["key"], e["value"]))
        return F.coalesce(rows, F.array(row(part, F.lit(None), F.lit(None))))

    total = F.array(row("dauTotal", F.lit(None), F.col("dauTotal")))
    return report.select(F.inline(F.concat(total, hours("dauTd"), hours("dauYd"))))
