"""Rows joined with the version of a keyed record that was current when they arrived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of arrival that a key's rows are split into.
RANGES = 32


def range_starts(arrivals: DataFrame, seq: str, ranges: int = RANGES) -> list[int]:
    """Arrival numbers that cut ``arrivals`` into ranges of about equally many rows; only ``seq`` is read."""
    shares = [i / ranges for i in range(1, ranges)]
    starts = arrivals.agg(F.percentile_approx(seq, shares).alias("starts")).first()[0]
    return sorted(set(starts or []))


def _range_of(seq: str, starts: Sequence[int]) -> Column:
    if not starts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(s).cast("bigint") for s in starts]), lambda s: s <= F.col(seq)))


def join_as_of(rows: DataFrame, versions: DataFrame, key: Column, version_key: str, seq: str, name: str, starts: Sequence[int]) -> DataFrame:
    """Adds the struct ``name``: the last of ``versions`` with ``version_key`` equal to ``key`` whose ``seq`` is not
    after the row's, or null if there is none.

    Rows and versions go through one union, in which a version is carried forward to the rows after it. A key's rows
    are split by ranges of ``seq``, so that a hot key is not one task; the last version of each range, at most one a
    range, is joined to the rows of later ranges that have none before them in their own. No range or cross join.

    Rows without a key have no version. Of several versions with one key and ``seq`` any one counts; a version and a
    row of one ``seq``: the version counts. ``rows`` may not have columns that start with ``_as_of``.
    """
    fields = [c for c in versions.columns if c not in (version_key, seq)]
    version = F.struct(*fields)
    row_schema, version_schema = F.struct(*rows.columns), versions.select(version.alias("v")).schema["v"].dataType
    own = rows.select(
        key.alias("_as_of_key"), F.col(seq).alias("_as_of_seq"), F.lit(1).alias("_as_of_side"), row_schema.alias("_as_of_row"),
        F.lit(None).cast(version_schema).alias("_as_of_version"),
    )
    known = versions.where(F.col(version_key).isNotNull()).select(
        F.col(version_key).alias("_as_of_key"), F.col(seq).alias("_as_of_seq"), F.lit(0).alias("_as_of_side"),
        F.lit(None).cast(own.schema["_as_of_row"].dataType).alias("_as_of_row"), version.alias("_as_of_version"),
    )
    place = _range_of("_as_of_seq", starts)
    before = Window.partitionBy("_as_of_key", "_as_of_range").orderBy("_as_of_seq", "_as_of_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = own.unionByName(known).withColumn("_as_of_range", place).withColumn("_as_of_near", F.last("_as_of_version", ignorenulls=True).over(before))
    placed = carried.where(F.col("_as_of_side") == 1).drop("_as_of_version", "_as_of_side", "_as_of_seq")
    ends = known.withColumn("_as_of_range", place).groupBy("_as_of_key", "_as_of_range").agg(F.max_by("_as_of_version", "_as_of_seq").alias("v"))
    # one entry a range at most
    by_key = ends.groupBy("_as_of_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_as_of_range").alias("r"), "v"))).alias("_as_of_ends"))
    joined = placed.join(by_key, "_as_of_key", "left")
    earlier = F.filter("_as_of_ends", lambda e: e["r"] < F.col("_as_of_range"))
    far = F.try_element_at(earlier, F.lit(-1))["v"]
    return joined.select("_as_of_row.*", F.coalesce("_as_of_near", far).alias(name))
