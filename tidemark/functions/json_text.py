"""Reading JSON text without letting one bad member spoil its record.

Members are read as text first and converted afterwards, so that a number sent as a string is
still a number and a value of the wrong type only nulls itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from tidemark.schemas import ZERO_BY_DEFAULT, strings


def looks_like_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def looks_like_array(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def long_of(text: Column) -> Column:
    """Whole number in ``text``; a fraction is cut off, anything else is null."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def value_of(text: Column, kind) -> Column:
    """``text`` as ``kind``, null where it cannot be read as that."""
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, LongType):
        return long_of(text)
    return text.try_cast(kind)


def text_members(text: Column, names) -> Column:
    """A struct with the named members of a JSON object, each as text."""
    return F.from_json(text, strings(*names))


def object_array(text: Column, schema: ArrayType) -> Column:
    """The array of objects in ``text``; null when it is anything else."""
    return F.when(looks_like_array(text), F.from_json(text, schema))


def typed_members(members: Column, schema: StructType) -> list[Column]:
    """Typed columns out of a struct of text members, with the schema's names."""
    columns = []
    for field in schema:
        column = value_of(members[field.name], field.dataType)
        if field.name in ZERO_BY_DEFAULT and isinstance(field.dataType, DoubleType):
            column = F.coalesce(column, F.lit(0.0))
        columns.append(column.alias(field.name))
    return columns
