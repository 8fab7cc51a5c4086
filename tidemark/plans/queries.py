"""The registered queries: each runs over whole star-schema tables.

All of them go through the JSON text the jobs really read, so parsing is part of what is checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as s
from tidemark.functions.dates import local_date
from tidemark.functions.json_text import text_members
from tidemark.operators import changes as ch
from tidemark.operators import dau
from tidemark.operators import documents as docs
from tidemark.operators import logs
from tidemark.operators import orders as od
from tidemark.operators import report
from tidemark.operators.as_of import range_starts
from tidemark.operators.dims import province_versions, user_versions
from tidemark.plans import pipelines as pl
from tidemark.sources import star
from tidemark.sources import tables as tb
from tidemark.sources.topics import FileTopics
from tidemark.streaming import jobs, state

AS_OF = star.AS_OF
# A day in the middle of the events, and a later "today", whose yesterday the report shows too.
REPORT_DAY, YESTERDAY, REPORT_TODAY = "2024-01-15", "2024-01-19", "2024-01-20"


def _utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _parsed(spark, sf_dir) -> DataFrame:
    return logs.parse_log(star.log_lines(_utc(spark), sf_dir))


# -- log split ------------------------------------------------------------------------------------


def log_errors(spark, sf_dir):
    errors = logs.split_errors(_parsed(spark, sf_dir))
    opened = errors.select("event_id", text_members(F.col("value"), ["error_code", "msg"]).alias("e"))
    return opened.select("event_id", "e.*")


def log_starts(spark, sf_dir):
    return logs.split_starts(_parsed(spark, sf_dir))


def log_pages(spark, sf_dir):
    return logs.split_pages(_parsed(spark, sf_dir))


def log_actions(spark, sf_dir):
    return logs.explode_actions(_parsed(spark, sf_dir))


def log_displays(spark, sf_dir):
    return logs.explode_displays(_parsed(spark, sf_dir))


def log_routes(spark, sf_dir):
    """Messages per topic after the one-pass split of good and damaged lines together."""
    _utc(spark)
    lines = star.log_lines(spark, sf_dir).unionByName(star.damaged_log_lines(spark, sf_dir))
    routed = logs.route_logs(logs.parse_log(lines))
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("cnt"))


def log_rejects(spark, sf_dir):
    parsed = logs.parse_log(star.damaged_log_lines(_utc(spark), sf_dir))
    return logs.rejected_logs(parsed).select("event_id", "reason")


# -- change log -----------------------------------------------------------------------------------


def _changes(spark, sf_dir):
    return star.change_lines(_utc(spark), sf_dir), star.fact_tables(spark)


def cdc_fact_counts(spark, sf_dir):
    messages = pl.topic_messages(*_changes(spark, sf_dir))
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("cnt"))


def _dim_view(rows: DataFrame) -> DataFrame:
    names = ["gender", "birthday", "name", "iso_code", "iso_3166_2", "area_code"]
    opened = rows.select(
        "dim_table", "dim_key", "id", "op", text_members(F.col("data"), names).alias("d")
    )
    return opened.select("dim_table", "dim_key", "id", "op", "d.*")


def dim_latest(spark, sf_dir):
    return _dim_view(pl.dimension_rows(*_changes(spark, sf_dir)))


def dim_latest_deletes(spark, sf_dir):
    return _dim_view(pl.dimension_rows(*_changes(spark, sf_dir), apply_deletes=True))


# -- daily active devices -------------------------------------------------------------------------


def first_pages(spark, sf_dir):
    return dau.first_pages(logs.split_pages(_parsed(spark, sf_dir)))


def dau_dedup(spark, sf_dir):
    rows = pl.active_devices(star.log_lines(_utc(spark), sf_dir), "event_id")
    return rows.withColumnRenamed("_seq", "event_id")


def _dau_inputs(spark, sf_dir):
    _utc(spark)
    lines = star.log_lines(spark, sf_dir)
    return lines, "event_id", star.users(spark, sf_dir), star.provinces(spark, sf_dir)


def dau_enriched(spark, sf_dir):
    return pl.enriched_devices(*_dau_inputs(spark, sf_dir), AS_OF).drop("_seq")


def dau_index(spark, sf_dir):
    """Everything processed on one date: two event days of a device share a document."""
    return pl.dau_index(*_dau_inputs(spark, sf_dir), AS_OF)


def _live_index(spark, sf_dir):
    """Every event processed on the day it happened."""
    return pl.dau_index(*_dau_inputs(spark, sf_dir), AS_OF, F.col("dt"))


def dau_total(spark, sf_dir):
    return report.dau_total(_live_index(spark, sf_dir), REPORT_DAY)


def dau_by_hour(spark, sf_dir):
    return report.dau_by_hour(_live_index(spark, sf_dir), REPORT_DAY)


def dau_by_hour_each_day(spark, sf_dir):
    return report.dau_by_hour_each_day(_live_index(spark, sf_dir))


def dau_realtime(spark, sf_dir):
    return report.unpack_realtime(report.dau_realtime(_live_index(spark, sf_dir), REPORT_DAY, REPORT_TODAY))


def _stored_index(spark, sf_dir):
    """The live documents as a stored table, in a folder of its own."""
    index = tb.dau_index(scratch_folder(spark))
    index.upsert(_live_index(spark, sf_dir), 0)
    return index


def index_report(spark, sf_dir):
    """The report as the service makes it: only the two days' stored documents are read."""
    index = _stored_index(spark, sf_dir)
    documents = tb.read_index(spark, index, REPORT_DAY, YESTERDAY)
    return report.unpack_realtime(report.dau_realtime(documents, REPORT_DAY, REPORT_TODAY))


def index_edited(spark, sf_dir):
    """Stored documents after edits by hand: a field patched in every document, and those of devices
    with urgent orders removed; then read back by id."""
    index = _stored_index(spark, sf_dir)
    patches = index.read(spark).select("mid", F.lit("channel").alias("field"), F.upper("channel").alias("new_value"), F.lit(1).alias("number"))
    index.edit(docs.patch_docs(index.read(spark), patches, "mid", ["number"]), 0, 1)
    gone = docs.docs_by_id(index.read(spark), _ordering_devices(spark, sf_dir), "mid")
    index.remove(gone.select("index_date", "mid"), 0, 2)
    return index.read(spark).select("index_date", "mid", "channel", "hr")


# -- orders ---------------------------------------------------------------------------------------


def _headers(spark, sf_dir):
    _utc(spark)
    return pl.enriched_headers(
        star.order_header_lines(spark, sf_dir),
        star.users(spark, sf_dir),
        star.provinces(spark, sf_dir),
        AS_OF,
    )


def _lines(spark, sf_dir):
    return pl.bound_lines(star.order_detail_lines(_utc(spark), sf_dir))


def order_enriched(spark, sf_dir):
    return _headers(spark, sf_dir)


def order_wide(spark, sf_dir):
    return od.join_orders(_headers(spark, sf_dir), _lines(spark, sf_dir))


def order_unmatched(spark, sf_dir):
    headers = pl.bound_headers(star.order_header_lines(_utc(spark), sf_dir))
    return od.waiting_headers(headers, _lines(spark, sf_dir)).select("id", "user_id", "create_time")


def _facts_inserted(changes: DataFrame, facts: DataFrame):
    """Headers and lines out of stored changes: only inserts go to the topics that are joined."""
    messages = ch.fact_messages(changes, facts)
    headers = pl.bound_headers(pl.on_topic(messages, s.ORDER_INFO_TOPIC))
    return headers, pl.bound_lines(pl.on_topic(messages, s.ORDER_DETAIL_TOPIC))


def _stored_changes(spark, sf_dir):
    """The change log, parsed once, and the fact tables."""
    lines, facts = _changes(spark, sf_dir)
    return pl.stored_changes(lines, f"{scratch_folder(spark)}/changes"), facts


def cdc_order_wide(spark, sf_dir):
    """Change log to wide rows, dimensions from the change log too."""
    changes, facts = _stored_changes(spark, sf_dir)
    headers, lines = _facts_inserted(changes, facts)
    dims = ch.latest_dims(ch.dim_changes(changes, facts), ["seq"])
    enriched = od.enrich_orders(headers, tb.user_dim(dims), tb.province_dim(dims), AS_OF)
    return od.join_orders(enriched, lines)


def cdc_order_wide_as_of(spark, sf_dir):
    """Change log to wide rows, each header with the dimension rows that were current when it arrived."""
    facts = star.fact_tables(_utc(spark))
    changes = pl.stored_changes(star.change_lines(spark, sf_dir, orders_among_updates=True), f"{scratch_folder(spark)}/changes")
    starts = range_starts(changes, "seq")
    messages = ch.fact_messages(changes, facts)
    of_dims = ch.dim_changes(changes, facts)
    headers = pl.bound_headers(messages.where(F.col("topic") == s.ORDER_INFO_TOPIC).select("seq", "value"))
    enriched = od.enrich_orders_as_of(headers, user_versions(of_dims, "seq"), province_versions(of_dims, "seq"), "seq", starts, AS_OF)
    return od.join_orders(enriched, pl.bound_lines(pl.on_topic(messages, s.ORDER_DETAIL_TOPIC)))


def order_pairs(spark, sf_dir):
    """Full outer pairing of inserted headers and lines."""
    pairs = od.pair_orders(*_facts_inserted(*_stored_changes(spark, sf_dir)))
    return pairs.select(
        "order_id", F.col("header.id").alias("header_id"), F.col("line.id").alias("detail_id")
    )


def order_waiting_lines(spark, sf_dir):
    """Lines of orders whose header was never inserted."""
    parked = od.waiting_lines(*_facts_inserted(*_stored_changes(spark, sf_dir)))
    return parked.select("id", "order_id", "sku_id", "order_price")


# -- stored documents -----------------------------------------------------------------------------


def _mid(key: str) -> Column:
    return F.concat(F.lit("mid_"), F.col(key).cast("string")).alias("mid")


def docs_patched(spark, sf_dir):
    """Every customer's document: gender to null for every third, channel to the market segment,
    a new duration for every fifth."""
    customers = star.table(_utc(spark), sf_dir, "customer")
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")

    def patch(field: str, value) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("new_value"), F.lit(1).alias("number"))

    patches = customers.select(
        _mid("c_custkey"),
        F.inline(
            F.array_compact(
                F.array(
                    F.when(key % 3 == 0, patch("user_gender", none)),
                    patch("channel", F.col("c_mktsegment")),
                    F.when(key % 5 == 0, patch("during_time", (key * 10).cast("string"))),
                    patch("no_such_field", F.lit("x")),
                )
            )
        ),
    )
    return docs.patch_docs(dau_index(spark, sf_dir), patches, "mid", ["number"])


def _ordering_devices(spark, sf_dir):
    """Devices of the customers who have placed an urgent order."""
    urgent = star.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(_mid("o_custkey"))


def docs_deleted(spark, sf_dir):
    return docs.delete_docs(dau_index(spark, sf_dir), _ordering_devices(spark, sf_dir), "mid")


def docs_by_id(spark, sf_dir):
    return docs.docs_by_id(dau_index(spark, sf_dir), _ordering_devices(spark, sf_dir), "mid")


# -- streaming jobs -------------------------------------------------------------------------------


# JSON messages repeat their names; as plain text, topics would be most of what a run writes.
TOPIC_FILES = "gzip"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share: spark.checkpoint.dir or, unset, the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/tidemark-{uuid.uuid4().hex}"


def _session(spark: SparkSession) -> SparkSession:
    """State is spread over the cluster's cores."""
    return jobs.streaming_session(_utc(spark), spark.sparkContext.defaultParallelism)


LONGEST_RUN = 3600  # seconds


def _run(query) -> None:
    """Waits for a bounded run, and raises what the query raised."""
    if not query.awaitTermination(LONGEST_RUN):
        query.stop()
        raise TimeoutError("a bounded run did not end")


def _halves(df: DataFrame):
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    return df.where(half == 0), df.where(half == 1)


def _messages(df: DataFrame, topic: str) -> DataFrame:
    return df.select(F.lit(topic).alias("topic"), "value")


def _fill_dims(spark, sf_dir, root: str) -> None:
    """Users and provinces into the dimension store, as the change router would."""
    users = star.users(spark, sf_dir)
    provinces = star.provinces(spark, sf_dir)
    rows = [
        df.select(
            F.lit(name.upper()).alias("dim_table"),
            F.concat(F.lit(f"{s.DIM_KEY_PREFIX}_{name.upper()}_"), F.col("id")).alias("dim_key"),
            "id",
            F.lit("I").alias("op"),
            F.to_json(F.struct("*")).alias("data"),
            F.lit(0).alias("seq"),
        )
        for name, df in ((s.USER_TABLE, users), (s.PROVINCE_TABLE, provinces))
    ]
    tb.dim_store(root).upsert(rows[0].unionByName(rows[1]), 0)


def _later_half_first(lines: DataFrame):
    """Events by time, the later half before the earlier: it comes up to a month late."""
    middle = lines.agg(F.avg("event_id")).first()[0]
    return lines.where(F.col("event_id") >= middle), lines.where(F.col("event_id") < middle)


def dau_stream(spark, sf_dir):
    """Log split and DAU jobs, stopped and resumed half-way; every event is processed on its day."""
    session = _session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", compression=TOPIC_FILES)
    dims, index = tb.dim_store(root), tb.dau_index(root)
    _fill_dims(session, sf_dir, root)
    for n, half in enumerate(_later_half_first(star.log_lines(session, sf_dir))):
        topics.write(_messages(half, s.BASE_LOG_TOPIC), "app", n)
        _run(jobs.log_split_job(session, topics, f"{root}/cp/log", jobs.WHAT_IS_THERE))
        _run(
            jobs.dau_job(
                session, topics, dims, index, f"{root}/cp/dau", jobs.WHAT_IS_THERE,
                as_of=local_date(F.col("ts")),
            )
        )
    documents = index.read(spark)
    return documents.select("index_date", "mid", "dt", "user_id", "province_id", "user_gender", "province_name")


def _order_stream(spark, sf_dir, resent: bool = False, repeated: bool = False):
    """Enrichment and join jobs; headers and lines come in opposite halves, so that most pairs meet
    across batches, in both orders."""
    session = _session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", compression=TOPIC_FILES)
    dims, index = tb.dim_store(root), tb.order_index(root)
    _fill_dims(session, sf_dir, root)
    headers = _halves(star.order_header_lines(session, sf_dir))
    lines = _halves(star.order_detail_lines(session, sf_dir))
    sent = [[(headers[0], "headers"), (lines[1], "lines")], [(headers[1], "headers"), (lines[0], "lines")]]
    if resent:
        again = [_with_status(h, RESENT) for h in headers]
        sent[1].append((again[0], "again"))  # before half of the lines' batch is joined
        sent.append([(again[1], "again")])  # after all of them
    if repeated:
        for n in (0, 1):
            sent[1 - n].append((lines[n].where(F.get_json_object("value", "$.id").cast("bigint") % 3 == 0), "repeated_lines"))
    for n, parts in enumerate(sent):
        for rows, producer in parts:
            topic = s.ORDER_DETAIL_TOPIC if producer.endswith("lines") else s.ORDER_INFO_TOPIC
            topics.write(_messages(rows, topic), producer, n)
        _run(
            jobs.order_enrich_job(
                session, topics, dims, f"{root}/cp/enrich", jobs.WHAT_IS_THERE, as_of=AS_OF
            )
        )
        _run(
            jobs.order_wide_job(
                session, topics, index, f"{root}/cp/wide", jobs.WHAT_IS_THERE, as_of=AS_OF
            )
        )
    return index.read(spark).drop("index_date")


RESENT = "R"


def _with_status(headers: DataFrame, status: str) -> DataFrame:
    """Every third header with another status."""
    every_third = F.get_json_object("value", "$.id").cast("bigint") % 3 == 0
    changed = F.regexp_replace("value", '"order_status":"[^"]*"', f'"order_status":"{status}"')
    return headers.where(every_third).select(changed.alias("value"))


def order_wide_stream(spark, sf_dir):
    return _order_stream(spark, sf_dir)


def order_wide_resent_stream(spark, sf_dir):
    """Every third header is sent again with another status, and that is what its documents say."""
    return _order_stream(spark, sf_dir, resent=True)


def order_wide_repeated_stream(spark, sf_dir):
    """Every third line is sent again, in a file of its own before its header or after: it is one line all the same."""
    return _order_stream(spark, sf_dir, repeated=True)


def order_wide_interval_stream(spark, sf_dir):
    """The join as a stream-stream join on arrival; headers and lines come in opposite halves."""
    session = _session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", compression=TOPIC_FILES)
    dims, index = tb.dim_store(root), tb.order_index(root)
    _fill_dims(session, sf_dir, root)
    headers = _halves(star.order_header_lines(session, sf_dir))
    lines = _halves(star.order_detail_lines(session, sf_dir))
    for n in (0, 1):
        topics.write(_messages(headers[n], s.ORDER_INFO_TOPIC), "headers", n)
        topics.write(_messages(lines[1 - n], s.ORDER_DETAIL_TOPIC), "lines", n)
        _run(jobs.order_enrich_job(session, topics, dims, f"{root}/cp/enrich", jobs.WHAT_IS_THERE, as_of=AS_OF))
        for topic in (s.ENRICHED_ORDER_TOPIC, s.ORDER_DETAIL_TOPIC):
            _run(jobs.on_time_job(session, topics, topic, f"{root}/marks/{topic}", f"{root}/cp/{topic}", jobs.WHAT_IS_THERE))
        _run(jobs.order_wide_interval_job(session, topics, index, f"{root}/cp/wide", jobs.WHAT_IS_THERE, as_of=AS_OF))
    return index.read(spark).drop("index_date")


def order_waiting_stream(spark, sf_dir):
    """Change log to order topics to the join; the lines that still wait are then read from its checkpoint."""
    session = _session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", compression=TOPIC_FILES)
    dims, index = tb.dim_store(root), tb.order_index(root)
    star.fact_tables(session).write.json(f"{root}/fact_tables")
    for n, half in enumerate(_halves(star.change_lines(session, sf_dir))):
        topics.write(_messages(half, s.CHANGE_TOPIC), "database", n)
        _run(jobs.change_router_job(session, topics, dims, f"{root}/fact_tables", f"{root}/cp/changes", jobs.WHAT_IS_THERE))
        _run(jobs.order_enrich_job(session, topics, dims, f"{root}/cp/enrich", jobs.WHAT_IS_THERE, as_of=AS_OF))
        _run(jobs.order_wide_job(session, topics, index, f"{root}/cp/wide", jobs.WHAT_IS_THERE, as_of=AS_OF))
    return state.waiting_lines(session, f"{root}/cp/wide").select("id", "order_id", "sku_id", "order_price")


def dim_stream(spark, sf_dir):
    """The change router job, a row's changes coming in separate files; the store read back."""
    session = _session(spark)
    root = scratch_folder(spark)
    topics = FileTopics(f"{root}/topics", compression=TOPIC_FILES, level="DEFAULT_COMPRESSION")
    dims = tb.dim_store(root)
    star.fact_tables(session).write.json(f"{root}/fact_tables")
    lines = star.change_lines(session, sf_dir)
    step = F.floor(F.col("seq") / star.SEQ_STEP)
    for n in range(3):
        topics.write(_messages(lines.where(step == n), s.CHANGE_TOPIC), "database", n)
        _run(
            jobs.change_router_job(
                session, topics, dims, f"{root}/fact_tables", f"{root}/cp", jobs.WHAT_IS_THERE,
                compact_every=2,
            )
        )
    rows = dims.read(spark, s.USER_TABLE.upper()).unionByName(dims.read(spark, s.PROVINCE_TABLE.upper()))
    return _dim_view(rows)


QUERIES = {
    f.__name__: f
    for f in (
        log_errors, log_starts, log_pages, log_actions, log_displays, log_routes, log_rejects,
        cdc_fact_counts, dim_latest, dim_latest_deletes,
        first_pages, dau_dedup, dau_enriched, dau_index,
        dau_total, dau_by_hour, dau_by_hour_each_day, dau_realtime, index_report, index_edited,
        order_enriched, order_wide, order_unmatched, cdc_order_wide, cdc_order_wide_as_of, order_pairs,
        order_waiting_lines,
        docs_patched, docs_deleted, docs_by_id,
        dau_stream, order_wide_stream, order_wide_resent_stream, order_wide_repeated_stream,
        order_wide_interval_stream, order_waiting_stream, dim_stream,
    )
}
