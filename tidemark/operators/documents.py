"""Changing stored documents: patch fields, delete, fetch by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.json_text import value_of
from tidemark.operators.keys import rows_with_keys, rows_without_keys


def patch_docs(docs: DataFrame, patches: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Sets single fields of documents.

    ``patches`` holds ``(<key>, field, new_value)``, the value as text, and the columns ``order``
    that order several patches of one field (the last wins). A patch to null is told apart from no
    patch. Patches of unknown documents or fields change nothing.
    """
    fields = [f for f in docs.schema if f.name != key]

    def last(name: str):
        mine = F.col("field") == name
        value = F.when(mine, F.struct("new_value"))
        return F.max_by(value, F.when(mine, F.struct(*order))).alias(f"_new_{name}")

    # One row per document, partial in every task; the join needs no other shuffle of it.
    known = patches.where(F.col("field").isin([f.name for f in fields]))
    by_doc = known.groupBy(key).agg(*[last(f.name) for f in fields])
    joined = docs.join(by_doc, key, "left")

    def patched(field):
        new = F.col(f"_new_{field.name}")
        value = value_of(new["new_value"], field.dataType)
        return F.when(new.isNotNull(), value).otherwise(F.col(field.name)).alias(field.name)

    columns = {f.name: patched(f) for f in fields}
    return joined.select(*[columns.get(c, F.col(c)) for c in docs.columns])


def delete_docs(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows_without_keys(docs, ids, key)


def docs_by_id(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows_with_keys(docs, ids, key)
