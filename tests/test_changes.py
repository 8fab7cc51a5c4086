import json

import pytest

from tidemark.operators import changes as ch
from tidemark.plans.pipelines import dimension_rows, topic_messages


@pytest.fixture
def facts(spark):
    return spark.createDataFrame([("order_info",), ("order_detail",)], "table_name string")


@pytest.fixture
def log(spark):
    def make(*changes):
        rows = [(i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(changes)]
        return spark.createDataFrame(rows, "seq long, value string")

    return make


def change(kind, table, **data):
    return {"type": kind, "table": table, "data": data}


def test_operations_and_topics(log, facts):
    lines = log(*[change(k, "order_info", id=i) for i, k in enumerate(
        ["bootstrap-insert", "insert", "update", "delete", "bootstrap-start", None])])
    rows = {(r.topic, r.value) for r in topic_messages(lines, facts).collect()}
    assert rows == {
        ("DWD_ORDER_INFO_I", '{"id":0}'), ("DWD_ORDER_INFO_I", '{"id":1}'),
        ("DWD_ORDER_INFO_U", '{"id":2}'), ("DWD_ORDER_INFO_D", '{"id":3}'),
    }


def test_every_other_table_is_a_dimension(log, facts):
    lines = log(change("insert", "user_info", id=1, gender="F"), change("update", "anything", id="x"),
                change("insert", "Order_Info", id=3), change("insert", "user_info", gender="M"))
    keys = {r.dim_key for r in dimension_rows(lines, facts).collect()}
    assert keys == {"DIM_USER_INFO_1", "DIM_ANYTHING_x", "DIM_ORDER_INFO_3", "DIM_USER_INFO_null"}


def test_last_change_replaces_the_whole_row(log, facts):
    lines = log(change("insert", "user_info", id=1, gender="F", birthday="2000-01-01"),
                change("update", "user_info", id=1, gender="M"))
    row = dimension_rows(lines, facts).first()
    assert json.loads(row.data) == {"id": 1, "gender": "M"} and row.op == "U"


def test_delete_writes_the_row_unless_deletes_are_applied(log, facts):
    lines = log(change("insert", "user_info", id=1, gender="F"), change("delete", "user_info", id=1, gender="F"),
                change("delete", "user_info", id=2), change("insert", "user_info", id=2))
    assert {r.dim_key: r.op for r in dimension_rows(lines, facts).collect()} == {
        "DIM_USER_INFO_1": "D", "DIM_USER_INFO_2": "I"}
    assert [r.dim_key for r in dimension_rows(lines, facts, apply_deletes=True).collect()] == ["DIM_USER_INFO_2"]


def test_unusable_changes_are_rejected(log):
    bad = ["{bad", '{"type":"insert","table":"t","data":{"id":1}', "[]", '{"type":"insert","data":{"id":1}}', '{"type":"insert","table":"t"}',
           '{"type":"insert","table":"t","data":7}']
    lines = log(*bad, change("insert", "t", id=1), change("table-create", "t"), "{}")
    parsed = ch.parse_changes(lines)
    assert [r.value for r in ch.rejected_changes(parsed).collect()] == bad
    assert ch.row_changes(parsed).count() == 1


def test_numbers_pass_through_exactly(log, facts):
    lines = log('{"type":"insert","table":"order_info","data":{"id":1,"amount":12345678901234567.25,"big":123456789012345678901}}')
    assert [r.value for r in topic_messages(lines, facts).collect()] == ['{"amount":12345678901234567.25,"big":123456789012345678901,"id":1}']
