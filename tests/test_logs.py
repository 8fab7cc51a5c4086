import json

import pytest

from tidemark import schemas as s
from tidemark.operators import logs

COMMON = {"ar": 3, "ba": "b", "ch": "c", "is_new": "1", "md": "m", "mid": "mid_7", "os": "o", "uid": 7, "vc": "v1"}
PAGE = {"during_time": "500", "item": "9", "item_type": "sku", "page_id": "detail", "source_type": "query"}
TS = 1704067211172


def line(**members):
    return json.dumps({"common": COMMON, "ts": TS, **members})


def run(split, frame):
    return [row.asDict() for row in split(logs.parse_log(frame)).collect()]


def test_page_record_has_renamed_columns_in_order(lines):
    frame = logs.split_pages(logs.parse_log(lines(line(page=PAGE))))
    assert frame.schema == s.PAGE_LOG
    row = frame.first()
    assert (row.province_id, row.user_id, row.mid) == ("3", "7", "mid_7")
    assert (row.during_time, row.page_item, row.last_page_id, row.ts) == (500, "9", None, TS)


def test_error_suppresses_everything_else(lines):
    frame = lines(line(err={"code": 1}, page=PAGE, start={}, actions=[{"action_id": "a"}]))
    assert [json.loads(r["value"]) for r in run(logs.split_errors, frame)] == [{"code": 1}]
    for split in (logs.split_starts, logs.split_pages, logs.explode_actions, logs.rejected_logs):
        assert run(split, frame) == []


def test_start_and_page_are_independent(lines):
    start = {"entry": "icon", "loading_time": 12, "open_ad_id": 5, "open_ad_ms": "77"}
    frame = lines(line(start=start, page=PAGE), line(start=start), line(page=PAGE))
    starts = run(logs.split_starts, frame)
    assert len(starts) == 2 and len(run(logs.split_pages, frame)) == 2
    assert list(starts[0]) == s.START_LOG.fieldNames()
    assert (starts[0]["open_ad_id"], starts[0]["open_ad_ms"], starts[0]["open_ad_skip_ms"]) == ("5", 77, None)


def test_actions_need_a_page_and_carry_the_line_time(lines):
    actions = [{"action_id": "a", "item": 1, "ts": 5}, {"action_id": "b"}]
    frame = lines(line(page=PAGE, actions=actions), line(actions=actions), line(page=PAGE, actions=[]),
                  line(page=PAGE, actions=None))
    rows = run(logs.explode_actions, frame)
    assert [(r["action_id"], r["action_item"], r["ts"], r["page_id"]) for r in rows] == [
        ("a", "1", TS, "detail"), ("b", None, TS, "detail")]
    assert list(rows[0]) == s.ACTION_LOG.fieldNames()
    assert len(run(logs.split_pages, frame)) == 3
    assert run(logs.rejected_logs, frame) == []


def test_display_order_is_text(lines):
    rows = run(logs.explode_displays, lines(line(page=PAGE, displays=[{"order": 4, "pos_id": "2"}])))
    assert (rows[0]["display_order"], rows[0]["display_pos_id"]) == ("4", "2")
    assert list(rows[0]) == s.DISPLAY_LOG.fieldNames()


@pytest.mark.parametrize(
    "text, reason",
    [
        ("{bad", "line"),
        ("", "line"),
        (line(page=PAGE)[:-1], "line"),
        ("[1]", "line"),
        ("null", "line"),
        (json.dumps({"common": COMMON, "page": PAGE}), "ts"),
        (json.dumps({"common": COMMON, "page": PAGE, "ts": "soon"}), "ts"),
        (line(err=None), "err"),
        (line(err=5), "err"),
        (json.dumps({"page": PAGE, "ts": TS}), "common"),
        (json.dumps({"common": None, "page": PAGE, "ts": TS}), "common"),
        (line(start=None), "start"),
        (line(page=[]), "page"),
        (line(start=None, page=7), "start,page"),
        (line(page=PAGE, actions={}), "actions"),
        (line(page=PAGE, displays=[{"order": 1}, None]), "displays"),
        (line(page=PAGE, actions=["x"], displays="y"), "actions,displays"),
    ],
)
def test_rejected_lines_keep_their_text(lines, text, reason):
    assert run(logs.rejected_logs, lines(text)) == [{"value": text, "reason": reason}]


def test_one_bad_member_does_not_void_the_line(lines):
    page = {**PAGE, "during_time": "long", "item": {"x": 1}}
    frame = lines(line(page=page, actions={}, displays=[{"order": 1}, None]))
    row = run(logs.split_pages, frame)[0]
    assert (row["during_time"], row["page_item"], row["mid"]) == (None, '{"x":1}', "mid_7")
    assert len(run(logs.explode_displays, frame)) == 1


def test_numbers_as_text_and_fractions(lines):
    text = json.dumps({"common": COMMON, "page": {**PAGE, "during_time": 12.7}, "ts": str(TS)})
    row = run(logs.split_pages, lines(text))[0]
    assert (row["during_time"], row["ts"]) == (12, TS)


def test_one_pass_routing_equals_the_single_outputs(lines):
    texts = [
        line(err={"code": 1}),
        line(start={"entry": "icon"}, page=PAGE, actions=[{"action_id": "a"}, {"action_id": "b"}]),
        line(page=PAGE, displays=[{"order": 1}, None]),
        line(page=5),
        "{bad",
    ]
    parsed = logs.parse_log(lines(*texts))
    routed = {}
    for row in logs.route_logs(parsed).collect():
        routed.setdefault(row.topic, []).append(row.value)
    splits = {
        s.START_TOPIC: logs.split_starts, s.PAGE_TOPIC: logs.split_pages,
        s.ACTION_TOPIC: logs.explode_actions, s.DISPLAY_TOPIC: logs.explode_displays,
    }
    for topic, split in splits.items():
        want = [{k: v for k, v in r.asDict().items() if v is not None} for r in split(parsed).collect()]
        assert [json.loads(v) for v in routed[topic]] == want
    assert [json.loads(v) for v in routed[s.ERROR_TOPIC]] == [{"code": 1}]
    assert routed[s.REJECTED_LOG_TOPIC] == [texts[2], texts[3], texts[4]]


def test_extra_columns_are_kept(spark):
    frame = spark.createDataFrame([(42, line(page=PAGE))], "seq long, value string")
    assert logs.split_pages(logs.parse_log(frame)).first().seq == 42
