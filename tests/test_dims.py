import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators.dims import add_province, add_user


@pytest.mark.parametrize(
    "birthday, as_of, years",
    [
        ("1986-10-15", "2023-10-14", 36),
        ("1986-10-15", "2023-10-15", 37),
        ("2000-02-29", "2001-02-28", 0),
        ("2000-02-29", "2001-03-01", 1),
        ("2000-02-29", "2004-02-29", 4),
        ("2023-05-01", "2023-04-30", 0),
        ("soon", "2023-01-01", None),
        (None, "2023-01-01", None),
    ],
)
def test_age_in_completed_years(spark, birthday, as_of, years):
    row = spark.createDataFrame([(birthday,)], "b string").select(
        dates.age_years(F.col("b"), dates.as_of_date(as_of)).alias("age"))
    assert row.first().age == years


@pytest.mark.parametrize("zone, date, hour", [("UTC", "2023-05-19", "14"), ("Asia/Shanghai", "2023-05-19", "22"),
                                              ("Pacific/Auckland", "2023-05-20", "02")])
def test_local_date_and_hour(spark, zone, date, hour):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    ts = F.lit(1684505093000).cast("bigint")
    row = session.range(1).select(dates.local_date(ts).alias("d"), dates.local_hour(ts).alias("h")).first()
    assert (row.d, row.h) == (date, hour)


def test_date_and_hour_of_text(spark):
    text = F.lit("2023-05-19 08:31:02")
    row = spark.range(1).select(dates.text_date(text).alias("d"), dates.text_hour(text).alias("h")).first()
    assert (row.d, row.h) == ("2023-05-19", "08")


def test_as_of_date(spark):
    row = spark.range(1).select(
        (dates.as_of_date() == F.current_date()).alias("today"),
        dates.previous_day(dates.as_of_date("2024-03-01")).cast("string").alias("before"),
    ).first()
    assert row.today and row.before == "2024-02-29"


def test_unmatched_dimensions_give_nulls(spark):
    users = spark.createDataFrame([("1", "F", "1990-01-01")], "id string, gender string, birthday string")
    provinces = spark.createDataFrame([("01", "N", "i", "x", "a")],
                                      "id string, name string, iso_code string, iso_3166_2 string, area_code string")
    rows = spark.createDataFrame([(1, "01"), (2, "1"), (None, None)], "user_id long, province_id string")
    out = add_province(add_user(rows, users, dates.as_of_date("2023-01-01"), "int"), provinces, "iso2")
    got = {(r.user_id, r.user_gender, r.user_age, r.province_name, r.iso2) for r in out.collect()}
    assert got == {(1, "F", 33, "N", "x"), (2, None, None, None, None), (None, None, None, None, None)}
