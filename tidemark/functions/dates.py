"""Dates, hours and ages. Local time is the session time zone throughout."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_date(as_of: Column | datetime.date | str | None = None) -> Column:
    """The processing date: today unless a date (or a column with one) is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def local_date(epoch_ms: Column) -> Column:
    """Epoch milliseconds -> ``yyyy-MM-dd``."""
    return F.timestamp_millis(epoch_ms).cast("date").cast("string")


def local_hour(epoch_ms: Column) -> Column:
    """Epoch milliseconds -> ``HH``."""
    return F.date_format(F.timestamp_millis(epoch_ms), "HH")


def text_date(datetime_text: Column) -> Column:
    """``yyyy-MM-dd`` of ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.split_part(datetime_text, F.lit(" "), F.lit(1))


def text_hour(datetime_text: Column) -> Column:
    """``HH`` of ``yyyy-MM-dd HH:mm:ss`` text."""
    time_part = F.split_part(datetime_text, F.lit(" "), F.lit(2))
    return F.split_part(time_part, F.lit(":"), F.lit(1))


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def age_years(birthday: Column, as_of: Column) -> Column:
    """Completed calendar years from ``birthday`` (``yyyy-MM-dd`` text) to ``as_of``.

    Someone born on 29 February completes the year on 1 March of a common year.
    """
    return F.timestamp_diff("YEAR", birthday.try_cast("date"), as_of).cast("int")
