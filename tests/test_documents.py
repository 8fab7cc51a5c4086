import pytest

from tidemark.operators import documents as docs


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", None, 3)], "id string, name string, n long")


def patches(spark, *rows):
    return spark.createDataFrame(rows, "id string, field string, new_value string, seq long")


def test_patch_to_null_differs_from_no_patch(spark, stored):
    frame = patches(spark, ("a", "name", None, 1), ("b", "n", "20", 1))
    assert {tuple(r) for r in docs.patch_docs(stored, frame, "id", ["seq"]).collect()} == {
        ("a", None, 1), ("b", "y", 20), ("c", None, 3)}


def test_last_patch_of_a_field_wins(spark, stored):
    frame = patches(spark, ("a", "name", "first", 1), ("a", "name", "last", 2), ("a", "n", "7", 0))
    assert ("a", "last", 7) in {tuple(r) for r in docs.patch_docs(stored, frame, "id", ["seq"]).collect()}


def test_unknown_documents_fields_and_the_key_stay(spark, stored):
    frame = patches(spark, ("zz", "name", "v", 1), ("a", "nope", "v", 1), ("a", "id", "q", 1))
    assert docs.patch_docs(stored, frame, "id", ["seq"]).exceptAll(stored).count() == 0


def test_delete_and_fetch(spark, stored):
    ids = spark.createDataFrame([("a",), ("a",), ("q",), (None,)], "id string")
    assert {r.id for r in docs.delete_docs(stored, ids, "id").collect()} == {"b", "c"}
    assert [r.id for r in docs.docs_by_id(stored, ids, "id").collect()] == ["a"]
