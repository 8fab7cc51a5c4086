"""What the plans must look like for the jobs to hold at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keys, logs
from tidemark.operators.dims import add_user
from tidemark.operators.orders import join_orders, pair_orders
from tidemark.plans import pipelines as pl
from tidemark.plans.queries import QUERIES
from tidemark.sources import star
from tidemark.sources.topics import FileTopics

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after adaptive execution has run it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df)


@pytest.fixture
def no_broadcast(spark):
    """Tables too large to broadcast, and any uneven partition counting as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10kb",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot(spark, n=60000):
    """A third of all rows have key 7."""
    key = F.when(F.col("n") % 3 == 0, 7).otherwise(F.col("n") % 997)
    return spark.range(0, n, 1, 8).withColumnRenamed("id", "n").withColumn("key", key.cast("bigint"))


def test_one_row_per_key_is_cut_before_the_shuffle(spark):
    frame = hot(spark).withColumn("payload", F.md5(F.col("n").cast("string")))
    for pick in (keys.first_per_key, keys.last_per_key):
        plan = plan_of(pick(frame, ["key"], ["n"]))
        assert re.search(r"Exchange hashpartitioning.*?WindowGroupLimit.*?Partial", plan, re.S)
    any_row = plan_of(keys.last_per_key(frame, ["key"], []))
    assert "partial_first" in any_row


def test_hot_user_is_split_at_run_time(spark, no_broadcast):
    facts = hot(spark).select(F.col("key").alias("user_id"), F.md5(F.col("n").cast("string")).alias("x"))
    users = spark.range(997).select(
        F.col("id").cast("string").alias("id"), F.lit("F").alias("gender"), F.lit("2000-01-01").alias("birthday"))
    joined = add_user(facts, users, F.lit("2023-01-01").cast("date"), "int")
    assert "skew=true" in final_plan(joined)
    assert joined.where("user_gender is null").count() == 0 and joined.count() == 60000


def test_hot_order_is_split_at_run_time(spark, no_broadcast):
    lines = pl.bound_lines(hot(spark).select(
        F.to_json(F.struct(F.col("n").alias("id"), F.col("key").alias("order_id"),
                           F.md5(F.col("n").cast("string")).alias("sku_name"))).alias("value")))
    headers = pl.bound_headers(spark.range(2000).select(F.to_json(F.struct("id")).alias("value")))
    empty = spark.createDataFrame([], "id string, gender string, birthday string")
    nowhere = spark.createDataFrame([], "id string, name string, iso_code string, iso_3166_2 string, area_code string")
    from tidemark.operators.orders import enrich_orders

    wide = join_orders(enrich_orders(headers, empty, nowhere, "2023-01-01"), lines)
    assert "skew=true" in final_plan(wide)
    assert wide.count() == 60000
    pairs = pair_orders(headers, lines)
    plan = final_plan(pairs)
    assert "skew=true" in plan and "FullOuter" not in plan
    assert pairs.count() == 60000 + 2000 - lines.select("order_id").distinct().count()


@needs_tables
@pytest.mark.parametrize("name", ["log_pages", "log_starts", "log_errors", "log_actions", "log_displays"])
def test_each_line_is_parsed_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("from_json(MapType") == 1
    for member in ("common", "page", "start", "actions", "displays"):
        parses = re.findall(rf"element_at\(_envelope#\d+, {member}, None, false\), Some\(", plan)
        assert len(parses) <= 1


@needs_tables
def test_split_and_routing_do_not_shuffle(spark, tmp_path):
    FileTopics(str(tmp_path)).write(
        star.log_lines(spark, SMALL).select(F.lit("t").alias("topic"), "value"), "p", 0)
    stored = spark.read.text(str(tmp_path))
    for split in (logs.route_logs, logs.split_pages, logs.explode_actions, logs.rejected_logs):
        assert "Exchange" not in plan_of(split(logs.parse_log(stored)))


@needs_tables
def test_no_query_crosses_tables_or_runs_python(spark):
    unwanted = "CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups"
    for name, query in QUERIES.items():
        if not name.endswith("_stream"):
            assert not re.search(unwanted, plan_of(query(spark, SMALL))), name


@needs_tables
def test_scans_read_the_needed_columns(spark):
    plan = plan_of(QUERIES["order_unmatched"](spark, SMALL))
    customer = re.search(r"ReadSchema: struct<c_custkey[^>]*>", plan).group(0)
    assert customer == "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>"
    assert "l_comment" not in plan and "o_orderpriority" not in plan
