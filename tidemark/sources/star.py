"""Inputs for the jobs, derived from the star-schema tables by column expressions.

``events`` become log lines, ``orders``/``lineitem``/``customer``/``nation`` become change-log
lines, order topics and dimensions. Every builder is a projection of a whole table (plus, for the
order headers, one join), so its cost and size follow the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as s

AS_OF = "2023-02-28"  # pinned processing date, so that ages and index names are reproducible

# Room between two changes of the same row, so that every change has its own arrival number.
SEQ_STEP = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def _mod(column: Column, n: int) -> Column:
    return F.pmod(column, F.lit(n))


# -- application log ------------------------------------------------------------------------------


def _log_parts(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        "event_id",
        "event_type",
        "user_id",
        k.alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
    k, u, e, kind = (F.col(c) for c in ("k", "user_id", "event_id", "event_type"))
    common = F.struct(
        _mod(u, 25).alias("ar"),
        F.concat(F.lit("brand_"), _text(_mod(k, 5))).alias("ba"),
        F.concat(F.lit("ch_"), _text(_mod(k, 3))).alias("ch"),
        _text(_mod(u, 2)).alias("is_new"),
        F.concat(F.lit("model_"), _text(_mod(k, 7))).alias("md"),
        F.concat(F.lit("mid_"), _text(u)).alias("mid"),
        F.when(_mod(k, 2) == 0, "Android").otherwise("iOS").alias("os"),
        u.alias("uid"),
        F.concat(F.lit("v"), _text(_mod(k, 4))).alias("vc"),
    )
    start = F.struct(
        F.when(_mod(k, 2) == 0, "icon").otherwise("notice").alias("entry"),
        (k * 10).alias("loading_time"),
        k.alias("open_ad_id"),
        _text(k * 100).alias("open_ad_ms"),
        F.when(_mod(k, 3) != 0, k * 7).alias("open_ad_skip_ms"),
    )
    page = F.struct(
        _text(k * 50).alias("during_time"),
        _mod(e, 1000).alias("item"),
        F.lit("sku_id").alias("item_type"),
        F.when(_mod(k, 3) != 0, "home").alias("last_page_id"),
        F.concat(F.lit("page_"), _text(_mod(k, 10))).alias("page_id"),
        F.when(_mod(k, 4) != 0, F.concat(F.lit("src_"), _text(_mod(k, 4)))).alias("source_type"),
    )
    err = F.struct(k.alias("error_code"), F.concat(F.lit("event "), _text(e)).alias("msg"))

    def action(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("act_"), _text(i)).alias("action_id"),
            (e + i).alias("item"),
            F.lit("sku_id").alias("item_type"),
        )

    def display(i: Column) -> Column:
        return F.struct(
            F.when(_mod(i, 2) == 0, "promotion").otherwise("query").alias("display_type"),
            (e * 10 + i).alias("item"),
            F.lit("sku_id").alias("item_type"),
            i.alias("order"),
            _text(_mod(k + i, 5)).alias("pos_id"),
        )

    def first(n: int, size: Column) -> Column:
        """1 to ``size``, which is at most ``n``; a sequence could not be empty."""
        return F.slice(F.array(*[F.lit(i + 1) for i in range(n)]), 1, size)

    has_page = kind.isin("error", "view", "click", "purchase") | (
        (kind == "signup") & (_mod(k, 2) == 0)
    )
    return base.select(
        "event_id",
        "k",
        common.alias("common"),
        F.when(kind == "signup", start).alias("start"),
        F.when(has_page, page).alias("page"),
        F.when(kind == "error", err).alias("err"),
        F.when(kind == "click", F.transform(first(2, _mod(k, 3)), action)).alias("actions"),
        F.when(kind == "purchase", F.transform(first(3, _mod(k, 4)), display)).alias("displays"),
        "ts",
    )


LOG_MEMBERS = ["common", "start", "page", "err", "actions", "displays", "ts"]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, value)``: one log line per event; ``event_id`` is the arrival order."""
    parts = _log_parts(table(spark, sf_dir, "events"))
    return parts.select("event_id", F.to_json(F.struct(*LOG_MEMBERS)).alias("value"))


def damaged_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of which most are broken in one of several ways, by ``event_id``."""
    how = _mod(F.col("event_id"), 9)
    lines = _log_parts(table(spark, sf_dir, "events"))

    def line(without: str = "") -> Column:
        return F.to_json(F.struct(*[c for c in LOG_MEMBERS if c != without]))

    def line_with(member: str, text: str) -> Column:
        """The line with its ``member``, if it has one, replaced by the given JSON text."""
        return F.concat(F.lit(f'{{"{member}":{text},'), F.substr(line(member), F.lit(2)))

    value = (
        F.when(how == 1, F.concat(F.lit("#"), line()))
        .when(how == 2, line("ts"))
        .when(how == 3, line("common"))
        .when(how == 4, line_with("err", "null"))
        .when(how == 5, line_with("start", "null"))
        .when(how == 6, line_with("page", "7"))
        .when(how == 7, line_with("actions", "{}"))
        .when(how == 8, line_with("displays", '[{"order":1},null]'))
        .otherwise(line())
    )
    return lines.select("event_id", value.alias("value"))


# -- dimensions -----------------------------------------------------------------------------------


def _gender(key: Column) -> Column:
    return F.when(_mod(key, 2) == 0, "F").otherwise("M")


def _birthday(key: Column) -> Column:
    days = _mod(key * 37, 15000).cast("int")
    return F.date_add(F.lit("1960-02-29").cast("date"), days).cast("string")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text(key).alias("id"), _gender(key).alias("gender"), _birthday(key).alias("birthday")
    )


def _province_columns(key: Column) -> list[Column]:
    return [
        F.col("n_name").alias("name"),
        F.concat(F.lit("P-"), _text(key)).alias("iso_code"),
        F.concat(F.lit("X-"), _text(key)).alias("iso_3166_2"),
        _text(key + 100000).alias("area_code"),
    ]


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(_text(key).alias("id"), *_province_columns(key))


# -- order topics ---------------------------------------------------------------------------------


def _datetime_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def _order_columns(province: Column | None) -> list[Column]:
    key = F.col("o_orderkey")
    placed = F.timestamp_seconds(
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + _mod(key, 86400)
    )
    columns = [
        key.alias("id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("total_amount"),
        _datetime_text(placed).alias("create_time"),
    ]
    return columns if province is None else [*columns, province.alias("province_id")]


def _detail_id() -> Column:
    """A number for a line: the order's, then a digest of the columns that tell its lines apart.

    Line numbers repeat within an order. Counting them off would sort each order's lines in one
    task; a digest needs no shuffle, and can only meet that of another line of the same order. It has
    28 bits, so that order numbers up to 2^35 fit beside it.
    """
    keys = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    rest = [F.col("l_quantity").cast("bigint"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    digest = F.md5(F.concat_ws("|", *[_text(c) for c in keys + rest]))
    part = F.conv(F.substr(digest, F.lit(1), F.lit(7)), 16, 10).cast("bigint")
    return F.shiftleft(F.col("l_orderkey").cast("bigint"), 28) + part


def _detail_columns() -> list[Column]:
    return [
        _detail_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_extendedprice").alias("order_price"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
        F.concat(F.lit("sku "), _text(F.col("l_partkey"))).alias("sku_name"),
        _datetime_text(F.col("l_shipdate").cast("timestamp")).alias("create_time"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("split_coupon_amount"),
    ]


def _orders_with_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def order_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers as topic records: JSON text in ``value``."""
    columns = _order_columns(F.col("c_nationkey"))
    return _orders_with_province(spark, sf_dir).select(
        F.to_json(F.struct(*columns)).alias("value")
    )


def order_detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as topic records: JSON text in ``value``."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_json(F.struct(*_detail_columns())).alias("value")
    )


# -- change log -----------------------------------------------------------------------------------


def fact_tables(spark: SparkSession) -> DataFrame:
    # An inline table has a known size, which rows sent from Python do not.
    return spark.sql("SELECT * FROM VALUES ('order_info'), ('order_detail') AS t (table_name)")


def _change(change_type: Column, table_name: str, data: list[Column], seq: Column) -> list[Column]:
    line = F.struct(
        change_type.alias("type"), F.lit(table_name).alias("table"), F.struct(*data).alias("data")
    )
    return [seq.alias("seq"), F.to_json(line).alias("value")]


def change_lines(spark: SparkSession, sf_dir: str, orders_among_updates: bool = False) -> DataFrame:
    """``(seq, value)``: the change log of four tables; ``seq`` is the arrival order of a row's
    changes.

    Customers are loaded, then every third is updated and every seventh deleted. Orders are
    inserted, updated or deleted by key. Each table also has a line that carries no row.
    ``orders_among_updates``: every second order comes after the updates of customers.
    """
    custkey, nationkey, orderkey = F.col("c_custkey"), F.col("n_nationkey"), F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem")
    orders = _orders_with_province(spark, sf_dir)

    loaded = [
        custkey.alias("id"), _gender(custkey).alias("gender"), _birthday(custkey).alias("birthday")
    ]
    updated = [
        custkey.alias("id"),
        F.lit("U").alias("gender"),
        _birthday(custkey + 1).alias("birthday"),
    ]
    order_type = (
        F.when(_mod(orderkey, 5) < 2, "insert")
        .when(_mod(orderkey, 5) == 2, "bootstrap-insert")
        .when(_mod(orderkey, 5) == 3, "update")
        .otherwise("delete")
    )
    order_seq = orderkey
    if orders_among_updates:
        order_seq = orderkey + F.when(_mod(orderkey, 2) == 0, SEQ_STEP + SEQ_STEP // 2).otherwise(0)
    latest = F.when(_mod(custkey, 3) == 0, F.struct(*updated)).otherwise(F.struct(*loaded))
    changes = [
        customers.select(*_change(F.lit("bootstrap-insert"), s.USER_TABLE, loaded, custkey)),
        customers.where(_mod(custkey, 3) == 0).select(
            *_change(F.lit("update"), s.USER_TABLE, updated, custkey + SEQ_STEP)
        ),
        customers.where(_mod(custkey, 7) == 0).select(
            *_change(
                F.lit("delete"),
                s.USER_TABLE,
                [latest[c].alias(c) for c in ("id", "gender", "birthday")],
                custkey + 2 * SEQ_STEP,
            )
        ),
        nations.select(
            *_change(
                F.lit("insert"),
                s.PROVINCE_TABLE,
                [nationkey.alias("id"), *_province_columns(nationkey)],
                nationkey.cast("bigint"),
            )
        ),
        orders.select(*_change(order_type, "order_info", _order_columns(F.col("c_nationkey")), order_seq)),
        lines.select(
            *_change(F.lit("insert"), "order_detail", _detail_columns(), F.col("l_orderkey"))
        ),
        table(spark, sf_dir, "region").select(
            F.col("r_regionkey").cast("bigint").alias("seq"),
            F.to_json(
                F.struct(F.lit("table-create").alias("type"), F.col("r_name").alias("table"))
            ).alias("value"),
        ),
    ]
    union = changes[0]
    for part in changes[1:]:
        union = union.unionByName(part)
    return union
