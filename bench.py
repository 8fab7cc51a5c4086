"""Times the headline queries, and plain Spark SQL for four of them in the same run.

The JSON inputs are written as files once, untimed, and both sides read those. ``BENCH_STREAM=1`` adds
the rows a second of the DAU and order jobs over 50 batches, and of the first and last ten of them.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
runs per query, of which the best counts. Results go to Spark's ``noop`` sink, which computes every
row and column and stores none.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as s
from tidemark.operators import logs
from tidemark.operators.topics import to_messages
from tidemark.plans.queries import QUERIES, scratch_folder
from tidemark.sources import star
from tidemark.sources import tables as tb
from tidemark.sources.topics import FileTopics
from tidemark.streaming.jobs import WHAT_IS_THERE, dau_job, order_enrich_job, streaming_session

HEADLINE = [
    "log_routes", "log_pages", "log_actions", "log_displays",
    "cdc_fact_counts", "dim_latest",
    "dau_by_hour_each_day", "dau_index", "dau_realtime",
    "order_enriched", "order_wide", "order_pairs", "cdc_order_wide",
    "docs_patched",
]

LINE_STRUCT = """struct<ts:string,err:string,
  common:struct<ar:string,ba:string,ch:string,is_new:string,md:string,mid:string,os:string,uid:string,vc:string>,
  start:struct<entry:string,loading_time:string,open_ad_id:string,open_ad_ms:string,open_ad_skip_ms:string>,
  page:struct<during_time:string,item:string,item_type:string,last_page_id:string,page_id:string,source_type:string>,
  actions:array<struct<action_id:string,item:string,item_type:string>>,
  displays:array<struct<display_type:string,item:string,item_type:string,order:string,pos_id:string>>>"""

# The same results as a Spark user's first SQL would compute them; well-formed input assumed.
PLAIN_SQL = {
    "dau_by_hour_each_day": """
SELECT dt, hr, count(*) AS cnt FROM (
  SELECT *, row_number() OVER (PARTITION BY mid, dt ORDER BY ts, event_id) AS n FROM (
    SELECT event_id, get_json_object(value, '$.common.mid') AS mid,
           CAST(get_json_object(value, '$.ts') AS BIGINT) AS ts,
           date_format(timestamp_millis(CAST(get_json_object(value, '$.ts') AS BIGINT)), 'yyyy-MM-dd') AS dt,
           date_format(timestamp_millis(CAST(get_json_object(value, '$.ts') AS BIGINT)), 'HH') AS hr
    FROM log_lines
    WHERE get_json_object(value, '$.err') IS NULL AND get_json_object(value, '$.page') IS NOT NULL
      AND get_json_object(value, '$.page.last_page_id') IS NULL))
WHERE n = 1 GROUP BY dt, hr""",
    "log_routes": f"""
WITH parsed AS (SELECT explode(array(from_json(value, '{LINE_STRUCT}'))) AS l FROM log_lines_twice),
flat AS (SELECT l.common.*, l.start, l.page, l.actions, l.displays, l.err, l.ts FROM parsed),
routed AS (SELECT explode(CASE WHEN err IS NOT NULL THEN array(struct('error' AS topic, err AS value)) ELSE concat(
    CASE WHEN start IS NOT NULL THEN array(struct('start' AS topic, to_json(struct(mid, uid, ar, start, ts)) AS value)) ELSE array() END,
    CASE WHEN page IS NOT NULL THEN array(struct('page' AS topic, to_json(struct(mid, uid, ar, page, ts)) AS value)) ELSE array() END,
    CASE WHEN page IS NOT NULL THEN transform(coalesce(actions, array()), a -> struct('action' AS topic, to_json(struct(mid, uid, ar, page, a, ts)) AS value)) ELSE array() END,
    CASE WHEN page IS NOT NULL THEN transform(coalesce(displays, array()), d -> struct('display' AS topic, to_json(struct(mid, uid, ar, page, d, ts)) AS value)) ELSE array() END
  ) END) AS m FROM flat)
SELECT m.topic, count(m.value) AS cnt FROM routed GROUP BY m.topic""",
    "dim_latest": """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY tab, id ORDER BY seq DESC) AS n FROM (
    SELECT seq, upper(get_json_object(value, '$.table')) AS tab, get_json_object(value, '$.data.id') AS id,
           get_json_object(value, '$.data') AS data
    FROM change_lines
    WHERE get_json_object(value, '$.type') IN ('bootstrap-insert', 'insert', 'update', 'delete')
      AND get_json_object(value, '$.table') NOT IN ('order_info', 'order_detail')))
WHERE n = 1""",
    "order_wide": """
WITH h AS (
  SELECT o.*, split(o.create_time, ' ')[0] AS create_date, split(split(o.create_time, ' ')[1], ':')[0] AS create_hour
  FROM (SELECT from_json(value, 'struct<id:bigint,province_id:bigint,order_status:string,user_id:bigint,
          total_amount:double,activity_reduce_amount:double,coupon_reduce_amount:double,
          original_total_amount:double,feight_fee:double,feight_fee_reduce:double,expire_time:string,
          refundable_time:string,create_time:string,operate_time:string>') AS o FROM header_lines)),
l AS (
  SELECT d.* FROM (SELECT from_json(value, 'struct<id:bigint,order_id:bigint,sku_id:bigint,order_price:double,
          sku_num:bigint,sku_name:string,create_time:string,split_total_amount:double,
          split_activity_amount:double,split_coupon_amount:double>') AS d FROM detail_lines))
SELECT l.*, h.province_id, h.order_status, h.user_id, h.total_amount, h.create_date, h.create_hour,
       p.name, p.area_code, p.iso_3166_2, p.iso_code, u.gender,
       timestampdiff(YEAR, CAST(u.birthday AS DATE), DATE '2023-02-28') AS user_age
FROM l JOIN h ON l.order_id = h.id LEFT JOIN provinces p ON CAST(h.province_id AS STRING) = p.id
     LEFT JOIN users u ON CAST(h.user_id AS STRING) = u.id""",
}


BUILDERS = ("log_lines", "damaged_log_lines", "change_lines", "order_header_lines", "order_detail_lines")


def write_inputs(spark: SparkSession, sf_dir: str) -> None:
    """The JSON inputs as files over all cores; from then on the builders give those."""
    folder = scratch_folder(spark)
    for name in BUILDERS:
        made = getattr(star, name)(spark, sf_dir)
        made.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/{name}")
        setattr(star, name, lambda spark, sf_dir, path=f"{folder}/{name}": spark.read.parquet(path))


def plain_views(spark: SparkSession, sf_dir: str) -> None:
    lines = star.log_lines(spark, sf_dir)
    lines.createOrReplaceTempView("log_lines")
    lines.unionByName(star.damaged_log_lines(spark, sf_dir)).createOrReplaceTempView("log_lines_twice")
    star.change_lines(spark, sf_dir).createOrReplaceTempView("change_lines")
    star.order_header_lines(spark, sf_dir).createOrReplaceTempView("header_lines")
    star.order_detail_lines(spark, sf_dir).createOrReplaceTempView("detail_lines")
    star.users(spark, sf_dir).createOrReplaceTempView("users")
    star.provinces(spark, sf_dir).createOrReplaceTempView("provinces")


def streams(spark: SparkSession, sf_dir: str, batches: int = 50) -> dict[str, dict[str, float]]:
    """Rows a second of jobs whose input comes in that many batches, one file each."""
    session = streaming_session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", max_files_per_trigger=1)
    pages = to_messages(logs.split_pages(logs.parse_log(star.log_lines(spark, sf_dir))).drop("event_id"), s.PAGE_TOPIC)
    headers = star.order_header_lines(spark, sf_dir).select(F.lit(s.ORDER_INFO_TOPIC).alias("topic"), "value")
    for name, rows in (("pages", pages), ("headers", headers)):
        topics.write(rows.repartition(batches), name, 0)
    out = {}
    for name, job in (
        ("dau_job", lambda: dau_job(session, topics, tb.dim_store(root), tb.dau_index(root), f"{root}/cp/dau", WHAT_IS_THERE, as_of=star.AS_OF)),
        ("order_enrich_job", lambda: order_enrich_job(session, topics, tb.dim_store(root), f"{root}/cp/enrich", WHAT_IS_THERE, as_of=star.AS_OF)),
    ):
        query = job()
        began, done = time.perf_counter(), {}
        while query.isActive and time.perf_counter() - began < 1800:
            query.awaitTermination(1)
            done |= {p["batchId"]: p for p in query.recentProgress}
        rates = [p["processedRowsPerSecond"] for _, p in sorted(done.items()) if p["numInputRows"]]
        mean = lambda x: round(sum(x) / max(len(x), 1), 1)
        out[name] = {"batches": len(rates), "rows_per_s": mean(rates), "first_ten": mean(rates[:10]), "last_ten": mean(rates[-10:])}
        print(name, out[name], file=sys.stderr, flush=True)
    return out


def seconds(make: callable, runs: int) -> float:
    best = None
    for _ in range(runs):
        began = time.perf_counter()
        frame: DataFrame = make()
        frame.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        best = took if best is None else min(best, took)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    write_inputs(spark, sf_dir)
    timings, plain = {}, {}
    for name in HEADLINE:
        timings[name] = seconds(lambda: QUERIES[name](spark, sf_dir), runs)
        print(name, timings[name], file=sys.stderr, flush=True)
    streamed = streams(spark, sf_dir) if os.environ.get("BENCH_STREAM") == "1" else {}
    if os.environ.get("BENCH_PLAIN", "1") == "1":
        plain_views(spark, sf_dir)
        for name, sql in PLAIN_SQL.items():
            plain[name] = seconds(lambda: spark.sql(sql), runs)
            print("plain", name, plain[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "plain_sql": plain,
                "streams": streamed,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
