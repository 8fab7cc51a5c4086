"""Application log lines -> error, start, page, action and display records.

A line is one JSON object with ``ts``, ``common`` and any of ``err``, ``start``, ``page``,
``actions`` and ``displays``. Which parts a line *has* decides what it yields:

* ``err`` present: the error object alone, nothing else of the line;
* otherwise ``start`` gives a start record and, independently, ``page`` a page record;
* with ``page``, every element of ``actions`` and ``displays`` gives a record of its own that
  repeats the common and page columns and the line's ``ts``.

A part that is present but unusable is left out, and its whole line shows up in
:func:`rejected_logs`; the usable parts of that line are still emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as s
from tidemark.functions.json_text import long_of, looks_like_object, object_array, text_members
from tidemark.functions.once import with_once

ENVELOPE = "_envelope"


def parse_log(lines: DataFrame) -> DataFrame:
    """Adds the top-level members of each line in ``value`` as a map of name -> JSON text.

    A map keeps "present but null" apart from "absent".
    """
    return with_once(lines, F.from_json("value", "map<string,string>"), ENVELOPE)


# -- conditions on a parsed line ------------------------------------------------------------------


def _has(member: str) -> Column:
    return F.coalesce(F.map_contains_key(ENVELOPE, member), F.lit(False))


def _text(member: str) -> Column:
    return F.try_element_at(F.col(ENVELOPE), F.lit(member))


def _ts() -> Column:
    return long_of(_text("ts"))


def _is_object(member: str) -> Column:
    return looks_like_object(_text(member))


def _readable() -> Column:
    return _ts().isNotNull()


def _is_error() -> Column:
    return _readable() & _is_object("err")


def _has_body() -> Column:
    return _readable() & ~_has("err") & _is_object("common")


def _is_start() -> Column:
    return _has_body() & _is_object("start")


def _is_page() -> Column:
    return _has_body() & _is_object("page")


# -- the parts of a record ------------------------------------------------------------------------

GROUPS = {"common": s.COMMON_MEMBERS, "start": s.START_MEMBERS, "page": s.PAGE_MEMBERS}
ARRAYS = {
    "actions": (s.ACTION_ARRAY, s.ACTION_MEMBERS, s.ACTION_TOPIC),
    "displays": (s.DISPLAY_ARRAY, s.DISPLAY_MEMBERS, s.DISPLAY_TOPIC),
}


def _others(parsed: DataFrame) -> list[str]:
    """Columns the caller had beside ``value`` (an arrival sequence, say); they are kept."""
    return [c for c in parsed.columns if c not in ("value", ENVELOPE)]


def _open(parsed: DataFrame, *members: str) -> DataFrame:
    """Parses the named members into columns ``_<member>``, in a projection of their own.

    Selecting the fields is left to the next projection: one parse then serves all of them.
    """
    columns = []
    for member in members:
        if member in ARRAYS:
            column = object_array(_text(member), ARRAYS[member][0])
        else:
            column = text_members(_text(member), GROUPS[member])
        columns.append(column.alias(f"_{member}"))
    return parsed.select("*", *columns, _ts().alias("_ts"))


def _columns(group: Column, members: dict[str, str]) -> list[Column]:
    return [
        (long_of(group[name]) if column in s.LONG_COLUMNS else group[name]).alias(column)
        for name, column in members.items()
    ]


def _opened(member: str) -> list[Column]:
    return _columns(F.col(f"_{member}"), GROUPS[member])


def _start_record() -> list[Column]:
    return [*_opened("common"), *_opened("start"), F.col("_ts").alias("ts")]


def _page_record(*element_columns: Column) -> list[Column]:
    return [*_opened("common"), *_opened("page"), *element_columns, F.col("_ts").alias("ts")]


# -- one output at a time -------------------------------------------------------------------------


def split_errors(parsed: DataFrame) -> DataFrame:
    """``err`` objects as JSON text in ``value``."""
    return parsed.where(_is_error()).select(*_others(parsed), _text("err").alias("value"))


def split_starts(parsed: DataFrame) -> DataFrame:
    opened = _open(parsed.where(_is_start()), "common", "start")
    return opened.select(*_others(parsed), *_start_record())


def split_pages(parsed: DataFrame) -> DataFrame:
    opened = _open(parsed.where(_is_page()), "common", "page")
    return opened.select(*_others(parsed), *_page_record())


def _explode_elements(parsed: DataFrame, member: str) -> DataFrame:
    opened = _open(parsed.where(_is_page() & _has(member)), "common", "page", member)
    elements = opened.select("*", F.explode_outer(f"_{member}").alias("_element")).where(
        F.col("_element").isNotNull()
    )
    columns = _columns(F.col("_element"), ARRAYS[member][1])
    return elements.select(*_others(parsed), *_page_record(*columns))


def explode_actions(parsed: DataFrame) -> DataFrame:
    """One row per element of ``actions`` on lines with a page; an empty or null array has none."""
    return _explode_elements(parsed, "actions")


def explode_displays(parsed: DataFrame) -> DataFrame:
    """One row per element of ``displays`` on lines with a page."""
    return _explode_elements(parsed, "displays")


# -- rejected lines -------------------------------------------------------------------------------


def _bad_array(member: str) -> Column:
    elements = F.col(f"_{member}")
    unusable = elements.isNull() | F.exists(elements, lambda e: e.isNull())
    return _is_page() & _text(member).isNotNull() & unusable


def _reject_reasons() -> Column:
    """Names of the parts of a line that cannot be used, in reading order; empty if all can."""
    known = F.col(ENVELOPE).isNotNull()
    problems = {
        "line": ~known,
        "ts": known & ~_readable(),
        "err": _readable() & _has("err") & ~_is_object("err"),
        "common": _readable() & ~_has("err") & ~_is_object("common"),
        "start": _has_body() & _has("start") & ~_is_object("start"),
        "page": _has_body() & _has("page") & ~_is_object("page"),
        "actions": _bad_array("actions"),
        "displays": _bad_array("displays"),
    }
    return F.concat_ws(",", *[F.when(bad, name) for name, bad in problems.items()])


def rejected_logs(parsed: DataFrame) -> DataFrame:
    """Whole lines with at least one unusable part, and ``reason``: the parts, comma-separated."""
    opened = _open(parsed, "actions", "displays")
    reasons = opened.select(*_others(parsed), "value", _reject_reasons().alias("reason"))
    return reasons.where(F.col("reason") != "")


# -- all outputs in one pass ----------------------------------------------------------------------


def _message(topic: str, value: Column) -> Column:
    return F.struct(F.lit(topic).alias("topic"), value.alias("value"))


def _no_messages() -> Column:
    return F.array().cast("array<struct<topic:string,value:string>>")


def _message_if(condition: Column, topic: str, value: Column) -> Column:
    return F.when(condition, F.array(_message(topic, value))).otherwise(_no_messages())


def _element_messages(member: str) -> Column:
    _, members, topic = ARRAYS[member]
    messages = F.transform(
        F.filter(f"_{member}", lambda e: e.isNotNull()),
        lambda e: _message(topic, F.to_json(F.struct(*_page_record(*_columns(e, members))))),
    )
    return F.coalesce(F.when(_is_page(), messages), _no_messages())


def route_logs(parsed: DataFrame) -> DataFrame:
    """Every output of every line as ``(topic, value)``, rejected lines included.

    One scan, one parse and no shuffle or cache, whatever the number of topics.
    """
    opened = _open(parsed, *GROUPS, *ARRAYS)
    messages = F.concat(
        _message_if(_is_error(), s.ERROR_TOPIC, _text("err")),
        _message_if(_is_start(), s.START_TOPIC, F.to_json(F.struct(*_start_record()))),
        _message_if(_is_page(), s.PAGE_TOPIC, F.to_json(F.struct(*_page_record()))),
        _element_messages("actions"),
        _element_messages("displays"),
        _message_if(_reject_reasons() != "", s.REJECTED_LOG_TOPIC, F.col("value")),
    )
    # The outer explode keeps Spark from testing the array's size, which would build it twice.
    routed = opened.select(messages.alias("_messages")).select(
        F.explode_outer("_messages").alias("_message")
    )
    return routed.where(F.col("_message").isNotNull()).select("_message.*")
