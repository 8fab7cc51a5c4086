import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.as_of import join_as_of, range_starts


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_the_version_of_the_arrival(spark, ranges):
    rng = random.Random(ranges)
    key = lambda: rng.choice(["hot"] * 4 + list("abc") + [None])
    versions = [(key(), s, f"v{s}") for s in rng.sample(range(1000), 120)]
    rows = [(i, key(), rng.randrange(1000)) for i in range(400)]
    by_key = {}
    for k, s, v in sorted(versions, key=lambda x: x[1]):
        by_key.setdefault(k, []).append((s, v))
    left = spark.createDataFrame(rows, "n int, k string, seq bigint")
    right = spark.createDataFrame(versions, "id string, seq bigint, v string")
    starts = range_starts(left.select("seq").unionByName(right.select("seq")), "seq", ranges)
    got = join_as_of(left, right, F.col("k"), "id", "seq", "dim", starts)
    assert got.columns == ["n", "k", "seq", "dim"]

    def want(k, s):
        mine = by_key.get(k, []) if k is not None else []
        at = bisect.bisect_right(mine, (s, "~"))
        return mine[at - 1][1] if at else None

    assert sorted((r.n, r.dim.v if r.dim else None) for r in got.collect()) == sorted((n, want(k, s)) for n, k, s in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_no_rows_or_no_versions(spark):
    left = spark.createDataFrame([(1, "a", 5)], "n int, k string, seq bigint")
    right = spark.createDataFrame([("a", 5, "x")], "id string, seq bigint, v string")
    assert [r.dim.v for r in join_as_of(left, right, F.col("k"), "id", "seq", "dim", []).collect()] == ["x"]
    assert [r.dim for r in join_as_of(left, right.limit(0), F.col("k"), "id", "seq", "dim", [3]).collect()] == [None]
    assert join_as_of(left.limit(0), right, F.col("k"), "id", "seq", "dim", [3]).collect() == []
    assert range_starts(left.limit(0), "seq") == []


def test_a_hot_key_is_split_by_range(spark):
    left = spark.range(9000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    right = spark.range(0, 9000, 1000).select(F.lit("hot").alias("id"), F.col("id").alias("seq"), F.col("id").alias("v"))
    starts = range_starts(left, "seq", 8)
    assert len(starts) == 7
    got = join_as_of(left, right, F.col("k"), "id", "seq", "dim", starts)
    assert got.where(F.col("dim.v") != F.floor(F.col("seq") / 1000) * 1000).count() == 0 and got.count() == 9000
    assert re.search(r"hashpartitioning\(_as_of_key#\d+, _as_of_range#\d+", got._jdf.queryExecution().executedPlan().toString())
