import pytest
from pyspark.sql import functions as F

from tidemark import schemas as s
from tidemark.operators import dau, report
from tidemark.operators.topics import bind_topic, copy_by_name, to_messages

DAY = 86400000
T0 = 1704067200000  # 2024-01-01 00:00 UTC


@pytest.fixture
def pages(spark):
    def make(*rows):
        """(mid, ts, page_id[, last_page_id])"""
        full = [{"mid": r[0], "ts": r[1], "page_id": r[2], "last_page_id": r[3] if len(r) > 3 else None,
                 "user_id": "1", "province_id": "1", "brand": "b", "during_time": 5} for r in rows]
        return spark.createDataFrame([tuple(f.get(c) for c in s.PAGE_LOG.fieldNames()) for f in full], s.PAGE_LOG)

    return make


@pytest.fixture
def dims(spark):
    return (spark.createDataFrame([("1", "F", "1990-01-01")], s.USER_DIM),
            spark.createDataFrame([("1", "N", "i", "x", "a")], s.PROVINCE_DIM))


def test_first_pages_keeps_null_only(pages):
    rows = dau.first_pages(pages(("a", T0, "p"), ("b", T0, "p", "home"), ("c", T0, "p", ""))).collect()
    assert [r.mid for r in rows] == ["a"]


def test_one_row_per_device_and_day(pages):
    rows = dau.dedup_daily(pages(("a", T0 + 5, "late"), ("a", T0 + 1, "early"), ("a", T0 + DAY, "next"),
                                 ("b", T0 + 5, "b")))
    assert {(r.mid, r.page_id) for r in rows.collect()} == {("a", "early"), ("a", "next"), ("b", "b")}
    assert rows.columns == s.PAGE_LOG.fieldNames()


def test_day_is_local(spark, pages):
    frame = pages(("a", T0 + 15 * 3600000, "x"), ("a", T0 + 17 * 3600000, "y"))
    assert dau.dedup_daily(frame).count() == 1
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")  # UTC+8: 23:00 and 01:00
        assert dau.dedup_daily(frame).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_enriched_record(pages, dims):
    out = dau.enrich_dau(pages(("a", T0 + 3 * 3600000, "p")), *dims, "2023-02-28")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in s.DAU_INFO]
    row = out.first()
    assert (row.user_gender, row.user_age, row.province_3166_2, row.dt, row.hr) == ("F", "33", "x", "2024-01-01", "03")


def test_documents_of_one_processing_date_overwrite(pages, dims):
    enriched = dau.enrich_dau(pages(("a", T0, "p1"), ("a", T0 + DAY, "p2")), *dims, "2023-02-28")
    one = dau.dau_documents(enriched, ["ts"], "2023-02-28").collect()
    assert [(r.index_date, r.mid, r.page_id) for r in one] == [("2023-02-28", "a", "p2")]
    assert dau.dau_documents(enriched, ["ts"], F.col("dt")).count() == 2


def docs(spark, *rows):
    return spark.createDataFrame(rows, "index_date string, mid string, hr string")


def test_report(spark):
    frame = docs(spark, ("2024-01-02", "a", "09"), ("2024-01-02", "b", "09"), ("2024-01-02", "c", "08"),
                 ("2024-01-02", "d", None), ("2024-01-01", "a", "23"), ("2023-12-31", "z", "01"))
    assert report.dau_total(frame, "2024-01-02").first().dauTotal == 4
    assert [tuple(r) for r in report.dau_by_hour(frame, "2024-01-02").collect()] == [("09", 2), ("08", 1)]
    row = report.dau_realtime(frame, "2024-01-02", "2024-01-02").first()
    assert (row.dauTotal, row.dauTd, row.dauYd) == (4, {"09": 2, "08": 1}, {"23": 1})


def test_yesterday_is_of_today_not_of_the_asked_day(spark):
    frame = docs(spark, ("2024-01-02", "a", "09"), ("2024-01-01", "a", "23"), ("2023-12-31", "z", "01"))
    row = report.dau_realtime(frame, "2024-01-02", "2024-01-01").first()
    assert (row.dauTd, row.dauYd) == ({"09": 1}, {"01": 1})
    same = report.dau_realtime(frame, "2024-01-01", "2024-01-02").first()
    assert (same.dauTd, same.dauYd) == ({"23": 1}, {"23": 1})


def test_days_without_documents(spark):
    frame = docs(spark, ("2024-01-02", "a", None))
    assert report.dau_total(frame, "2020-01-01").first().dauTotal == 0
    missing = report.dau_realtime(frame, "2020-01-01", "2020-01-05").first()
    assert (missing.dauTotal, missing.dauTd, missing.dauYd) == (0, None, None)
    assert report.dau_realtime(frame, "2024-01-02", "2020-01-05").first().dauTd == {}


def test_thirty_hours_at_most_ties_by_hour(spark):
    frame = docs(spark, *[("d", f"m{i}", f"h{i:02d}") for i in range(40)], ("d", "x", "h39"))
    top = [r.hr for r in report.dau_by_hour(frame, "d").collect()]
    assert top == ["h39"] + [f"h{i:02d}" for i in range(29)]
    assert set(report.dau_realtime(frame, "d", "2020-01-05").first().dauTd) == set(top)
    assert {r.hr for r in report.dau_by_hour_each_day(frame).collect()} == set(top)


def test_messages_leave_nulls_out_and_bind_back(spark):
    frame = spark.createDataFrame([(1, 2, None)], "id long, order_id long, sku_name string")
    message = to_messages(frame, "t").first()
    assert (message.topic, message.value) == ("t", '{"id":1,"order_id":2}')
    row = bind_topic(to_messages(frame), s.ORDER_DETAIL).first()
    assert (row.id, row.sku_name, row.order_price, row.split_total_amount) == (1, None, None, 0.0)


def test_bind_reads_numbers_sent_as_text(lines):
    row = bind_topic(lines('{"id":"7","order_price":"1.5","sku_num":{"x":1},"sku_name":5}'), s.ORDER_DETAIL).first()
    assert (row.id, row.order_price, row.sku_num, row.sku_name) == (7, 1.5, None, "5")


def test_copy_by_name(spark):
    frame = spark.createDataFrame([(1, "x", "gone")], "ts int, mid string, brand string")
    assert copy_by_name(frame, s.DAU_INFO).dtypes == [("mid", "string"), ("ts", "bigint")]
