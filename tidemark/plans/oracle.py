"""The registered queries as SQL straight over the star-schema tables, for checking results.

Nothing here goes through JSON: the input rules of :mod:`tidemark.sources.star` and the operators'
semantics are stated a second time, on the typed columns.
"""

from __future__ import annotations

AS_OF = "2023-02-28"
REPORT_DAY, YESTERDAY = "2024-01-15", "2024-01-19"

# ---- inputs -------------------------------------------------------------------------------------

EVENT = """
ev AS (
  SELECT event_id, event_type, user_id AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) // 1000 AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%H') AS hour
  FROM events)"""

COMMON = """
  CAST(u % 25 AS VARCHAR) AS province_id, 'brand_' || (k % 5) AS brand, 'ch_' || (k % 3) AS channel,
  CAST(u % 2 AS VARCHAR) AS is_new, 'model_' || (k % 7) AS model, 'mid_' || u AS mid,
  CASE WHEN k % 2 = 0 THEN 'Android' ELSE 'iOS' END AS operate_system,
  CAST(u AS VARCHAR) AS user_id, 'v' || (k % 4) AS version_code"""

PAGE = """
  CAST(k * 50 AS BIGINT) AS during_time, CAST(event_id % 1000 AS VARCHAR) AS page_item,
  'sku_id' AS page_item_type, CASE WHEN k % 3 <> 0 THEN 'home' END AS last_page_id,
  'page_' || (k % 10) AS page_id, CASE WHEN k % 4 <> 0 THEN 'src_' || (k % 4) END AS source_type"""

HAS_PAGE = "(event_type IN ('view', 'click', 'purchase') OR (event_type = 'signup' AND k % 2 = 0))"

PAGES = f"""
pages_log AS (SELECT event_id, {COMMON}, {PAGE}, ts, day, hour FROM ev WHERE {HAS_PAGE})"""

USER = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         DATE '1960-02-29' + CAST((c_custkey * 37) % 15000 AS INTEGER) AS birthday
  FROM customer)"""

PROVINCE = """
provinces AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'P-' || n_nationkey AS iso_code,
         'X-' || n_nationkey AS iso_3166_2, CAST(n_nationkey + 100000 AS VARCHAR) AS area_code
  FROM nation)"""

HEADER = """
headers AS (
  SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS province_id, o_orderstatus AS order_status,
         o_custkey AS user_id, o_totalprice AS total_amount,
         0.0::DOUBLE AS activity_reduce_amount, 0.0::DOUBLE AS coupon_reduce_amount,
         0.0::DOUBLE AS original_total_amount, 0.0::DOUBLE AS feight_fee, 0.0::DOUBLE AS feight_fee_reduce,
         CAST(NULL AS VARCHAR) AS expire_time, CAST(NULL AS VARCHAR) AS refundable_time,
         strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS create_time,
         CAST(NULL AS VARCHAR) AS operate_time
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LINE = """
lines AS (
  SELECT (l_orderkey << 28) + CAST('0x' || substr(md5(concat_ws('|', l_linenumber, l_partkey, l_suppkey,
                                           CAST(l_quantity AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))),
                             1, 7) AS BIGINT) AS id,
         l_orderkey AS order_id, l_partkey AS sku_id, l_extendedprice AS order_price,
         CAST(l_quantity AS BIGINT) AS sku_num, 'sku ' || l_partkey AS sku_name,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS create_time,
         0.0::DOUBLE AS split_total_amount, 0.0::DOUBLE AS split_activity_amount,
         l_extendedprice * l_discount AS split_coupon_amount
  FROM lineitem)"""


def _age(birthday: str) -> str:
    as_of = f"DATE '{AS_OF}'"
    not_yet = f"(month({birthday}), day({birthday})) > (month({as_of}), day({as_of}))"
    return f"(year({as_of}) - year({birthday}) - CASE WHEN {not_yet} THEN 1 ELSE 0 END)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


# ---- log split ----------------------------------------------------------------------------------

LOG = {
    "log_errors": _with(EVENT) + """
SELECT event_id, CAST(k AS VARCHAR) AS error_code, 'event ' || event_id AS msg
FROM ev WHERE event_type = 'error'""",
    "log_starts": _with(EVENT) + f"""
SELECT event_id, {COMMON}, CASE WHEN k % 2 = 0 THEN 'icon' ELSE 'notice' END AS entry,
       CAST(k * 10 AS BIGINT) AS loading_time, CAST(k AS VARCHAR) AS open_ad_id,
       CAST(k * 100 AS BIGINT) AS open_ad_ms,
       CASE WHEN k % 3 <> 0 THEN CAST(k * 7 AS BIGINT) END AS open_ad_skip_ms, ts
FROM ev WHERE event_type = 'signup'""",
    "log_pages": _with(EVENT, PAGES) + "SELECT * EXCLUDE (day, hour) FROM pages_log",
    "log_actions": _with(EVENT) + f"""
SELECT event_id, {COMMON}, {PAGE}, 'act_' || i AS action_id, CAST(event_id + i AS VARCHAR) AS action_item,
       'sku_id' AS action_item_type, ts
FROM ev, generate_series(1, 2) AS g(i) WHERE event_type = 'click' AND i <= k % 3""",
    "log_displays": _with(EVENT) + f"""
SELECT event_id, {COMMON}, {PAGE}, CASE WHEN i % 2 = 0 THEN 'promotion' ELSE 'query' END AS display_type,
       CAST(event_id * 10 + i AS VARCHAR) AS display_item, 'sku_id' AS display_item_type,
       CAST(i AS VARCHAR) AS display_order, CAST((k + i) % 5 AS VARCHAR) AS display_pos_id, ts
FROM ev, generate_series(1, 3) AS g(i) WHERE event_type = 'purchase' AND i <= k % 4""",
}

# What is wrong with a damaged line, by its number: an error line keeps only its error object, so
# damage elsewhere in it goes unseen; an array is looked at only beside a page.
_DAMAGE = f"""
damaged AS (
  SELECT *, event_id % 9 AS how, event_type = 'error' AS is_error, {HAS_PAGE} AS has_page,
         event_type = 'click' AS has_actions, event_type = 'purchase' AS has_displays
  FROM ev),
judged AS (
  SELECT *, CASE
      WHEN how = 1 THEN 'line'
      WHEN how = 2 THEN 'ts'
      WHEN how = 4 THEN 'err'
      WHEN is_error THEN NULL
      WHEN how = 3 THEN 'common'
      WHEN how = 5 THEN 'start'
      WHEN how = 6 THEN 'page'
      WHEN how = 7 AND has_page THEN 'actions'
      WHEN how = 8 AND has_page THEN 'displays' END AS reason
  FROM damaged)"""

LOG["log_rejects"] = _with(EVENT, _DAMAGE) + """
SELECT event_id, reason FROM judged WHERE reason IS NOT NULL"""

_GOOD = f"""
good AS (SELECT *, 0 AS how, event_type = 'error' AS is_error, {HAS_PAGE} AS has_page FROM ev),
every AS (
  SELECT event_type, k, how, is_error, has_page, NULL AS reason FROM good
  UNION ALL SELECT event_type, k, how, is_error, has_page, reason FROM judged)"""

# Damage takes away the part it hits and, for `line`, `ts`, `common` and `err`, all parts.
LOG["log_routes"] = _with(EVENT, _DAMAGE, _GOOD) + """
, flat AS (
  SELECT 'DWD_ERROR_LOG' AS topic, 1 AS n FROM every WHERE is_error AND how NOT IN (1, 2, 4)
  UNION ALL SELECT 'DWD_START_LOG', 1 FROM every WHERE event_type = 'signup' AND how NOT IN (1, 2, 3, 4, 5)
  UNION ALL SELECT 'DWD_PAGE_LOG', 1 FROM every WHERE has_page AND how NOT IN (1, 2, 3, 4, 6)
  UNION ALL SELECT 'DWD_PAGE_ACTION_LOG', k % 3 FROM every
            WHERE event_type = 'click' AND how NOT IN (1, 2, 3, 4, 6, 7)
  UNION ALL SELECT 'DWD_PAGE_DISPLAY_LOG', k % 4 FROM every
            WHERE event_type = 'purchase' AND how NOT IN (1, 2, 3, 4, 6, 8)
  UNION ALL SELECT 'DWD_PAGE_DISPLAY_LOG', 1 FROM every WHERE has_page AND how = 8
  UNION ALL SELECT 'ODS_BASE_LOG_REJECTED', 1 FROM every WHERE reason IS NOT NULL)
SELECT topic, CAST(sum(n) AS BIGINT) AS cnt FROM flat GROUP BY topic HAVING sum(n) > 0"""

# ---- change log ---------------------------------------------------------------------------------

_LATEST = """
dims AS (
  SELECT 'USER_INFO' AS dim_table, 'DIM_USER_INFO_' || c_custkey AS dim_key,
         CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 7 = 0 THEN 'D' WHEN c_custkey % 3 = 0 THEN 'U' ELSE 'I' END AS op,
         CASE WHEN c_custkey % 3 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CAST(DATE '1960-02-29' + CAST(((c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) * 37)
                                       % 15000 AS INTEGER) AS VARCHAR) AS birthday,
         NULL AS name, NULL AS iso_code, NULL AS iso_3166_2, NULL AS area_code
  FROM customer
  UNION ALL
  SELECT 'BASE_PROVINCE', 'DIM_BASE_PROVINCE_' || n_nationkey, CAST(n_nationkey AS VARCHAR), 'I',
         NULL, NULL, n_name, 'P-' || n_nationkey, 'X-' || n_nationkey,
         CAST(n_nationkey + 100000 AS VARCHAR)
  FROM nation)"""

CHANGES = {
    "cdc_fact_counts": """
SELECT topic, count(*) AS cnt FROM (
  SELECT CASE WHEN o_orderkey % 5 < 3 THEN 'DWD_ORDER_INFO_I' WHEN o_orderkey % 5 = 3 THEN 'DWD_ORDER_INFO_U'
              ELSE 'DWD_ORDER_INFO_D' END AS topic
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'DWD_ORDER_DETAIL_I' FROM lineitem) GROUP BY topic""",
    "dim_latest": _with(_LATEST) + "SELECT * FROM dims",
    "dim_latest_deletes": _with(_LATEST) + "SELECT * FROM dims WHERE op <> 'D'",
    "dim_stream": _with(_LATEST) + "SELECT * FROM dims",
}

# ---- daily active devices -----------------------------------------------------------------------

_FIRST = "first_log AS (SELECT * FROM pages_log WHERE last_page_id IS NULL)"
_DEDUP = """
active AS (
  SELECT * FROM first_log QUALIFY row_number() OVER (PARTITION BY mid, day ORDER BY ts, event_id) = 1)"""
_ENRICHED = f"""
enriched AS (
  SELECT event_id, a.mid, a.user_id, a.province_id, a.channel, a.is_new, a.model, a.operate_system,
         a.version_code, a.page_id, a.page_item, a.page_item_type, a.during_time,
         u.gender AS user_gender, CAST({_age("u.birthday")} AS VARCHAR) AS user_age,
         p.name AS province_name, p.iso_code AS province_iso_code, p.iso_3166_2 AS province_3166_2,
         p.area_code AS province_area_code, a.day AS dt, a.hour AS hr, a.ts
  FROM active a LEFT JOIN users u ON a.user_id = u.id LEFT JOIN provinces p ON a.province_id = p.id)"""
_INDEX = f"""
docs AS (
  SELECT * EXCLUDE (event_id), '{AS_OF}' AS index_date FROM enriched
  QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ts DESC, event_id DESC) = 1)"""
_ACTIVE = (EVENT, PAGES, _FIRST, _DEDUP)
_DAU = (*_ACTIVE, USER, PROVINCE, _ENRICHED)
_DOCS = (*_DAU, _INDEX)
_URGENT = "(SELECT 'mid_' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"

_REPORT = f"""
SELECT 'dauTotal' AS part, CAST(NULL AS VARCHAR) AS hr, count(*) AS cnt FROM enriched WHERE dt = '{REPORT_DAY}'
UNION ALL SELECT 'dauTd', hr, count(*) FROM enriched WHERE dt = '{REPORT_DAY}' GROUP BY hr
UNION ALL SELECT 'dauYd', hr, count(*) FROM enriched WHERE dt = '{YESTERDAY}' GROUP BY hr"""

DAU = {
    "first_pages": _with(EVENT, PAGES, _FIRST) + "SELECT * EXCLUDE (day, hour) FROM first_log",
    "dau_dedup": _with(*_ACTIVE) + "SELECT * EXCLUDE (day, hour) FROM active",
    "dau_enriched": _with(*_DAU) + "SELECT * EXCLUDE (event_id) FROM enriched",
    "dau_index": _with(*_DOCS) + "SELECT * FROM docs",
    "dau_total": _with(*_DAU) + f"SELECT count(*) AS \"dauTotal\" FROM enriched WHERE dt = '{REPORT_DAY}'",
    "dau_by_hour": _with(*_DAU) + f"""
SELECT hr, count(*) AS cnt FROM enriched WHERE dt = '{REPORT_DAY}' GROUP BY hr ORDER BY cnt DESC, hr LIMIT 30""",
    "dau_by_hour_each_day": _with(*_DAU) + """
SELECT dt AS index_date, hr, count(*) AS cnt FROM enriched GROUP BY dt, hr""",
    "dau_realtime": _with(*_DAU) + _REPORT,
    "index_report": _with(*_DAU) + _REPORT,
    "index_edited": _with(*_DAU) + f"""
SELECT dt AS index_date, mid, upper(channel) AS channel, hr FROM enriched WHERE mid NOT IN {_URGENT}""",
    "dau_stream": _with(*_DAU) + """
SELECT dt AS index_date, mid, dt, user_id, province_id, user_gender, province_name FROM enriched""",
    "docs_patched": _with(*_DOCS) + """
SELECT d.* REPLACE (
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE user_gender END AS user_gender,
  coalesce(c_mktsegment, channel) AS channel,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 ELSE during_time END AS during_time)
FROM docs d LEFT JOIN customer ON d.mid = 'mid_' || c_custkey""",
    "docs_deleted": _with(*_DOCS) + f"SELECT * FROM docs WHERE mid NOT IN {_URGENT}",
    "docs_by_id": _with(*_DOCS) + f"SELECT * FROM docs WHERE mid IN {_URGENT}",
}

# ---- orders -------------------------------------------------------------------------------------


def _enriched_headers(where: str = "TRUE") -> str:
    return f"""
enriched AS (
  SELECT h.*, substr(h.create_time, 1, 10) AS create_date, substr(h.create_time, 12, 2) AS create_hour,
         p.name AS province_name, p.area_code AS province_area_code, p.iso_3166_2 AS province_3166_2_code,
         p.iso_code AS province_iso_code, CAST({_age("u.birthday")} AS INTEGER) AS user_age,
         u.gender AS user_gender
  FROM headers h LEFT JOIN provinces p ON CAST(h.province_id AS VARCHAR) = p.id
       LEFT JOIN users u ON CAST(h.user_id AS VARCHAR) = u.id
  WHERE {where})"""


_CDC_USER = """
users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 3 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         DATE '1960-02-29' + CAST(((c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) * 37)
                                  % 15000 AS INTEGER) AS birthday
  FROM customer)"""

_WIDE = """
SELECT l.id AS detail_id, l.order_id, l.sku_id, l.order_price, l.sku_num, l.sku_name,
       l.split_total_amount, l.split_activity_amount, l.split_coupon_amount,
       h.* EXCLUDE (id, create_time), l.create_time
FROM lines l JOIN enriched h ON l.order_id = h.id"""

# Headers by the user and province of their arrival: even orders come after all updates, odd ones among the first loads.
_AS_OF = f"""
enriched AS (
  SELECT h.*, substr(h.create_time, 1, 10) AS create_date, substr(h.create_time, 12, 2) AS create_hour,
         p.name AS province_name, p.area_code AS province_area_code, p.iso_3166_2 AS province_3166_2_code,
         p.iso_code AS province_iso_code, CAST({_age("u.birthday")} AS INTEGER) AS user_age, u.gender AS user_gender
  FROM headers h LEFT JOIN provinces p ON h.province_id = CAST(p.id AS BIGINT) AND (h.id % 2 = 0 OR h.province_id <= h.id)
       LEFT JOIN (SELECT *, FALSE AS late FROM users_loaded UNION ALL SELECT *, TRUE AS late FROM users) u
         ON h.user_id = CAST(u.id AS BIGINT) AND u.late = (h.id % 2 = 0) AND (h.id % 2 = 0 OR h.user_id <= h.id)
  WHERE h.id % 5 < 3)"""

_INSERTED = "id % 5 < 3"

ORDERS = {
    "order_enriched": _with(HEADER, USER, PROVINCE, _enriched_headers()) + "SELECT * FROM enriched",
    "order_wide": _with(HEADER, LINE, USER, PROVINCE, _enriched_headers()) + _WIDE,
    "order_wide_stream": _with(HEADER, LINE, USER, PROVINCE, _enriched_headers()) + _WIDE,
    "order_wide_interval_stream": _with(HEADER, LINE, USER, PROVINCE, _enriched_headers()) + _WIDE,
    "order_wide_repeated_stream": _with(HEADER, LINE, USER, PROVINCE, _enriched_headers()) + _WIDE,
    "order_wide_resent_stream": _with(HEADER, LINE, USER, PROVINCE, _enriched_headers()) + f"""
SELECT * REPLACE (CASE WHEN order_id % 3 = 0 THEN 'R' ELSE order_status END AS order_status) FROM ({_WIDE})""",
    "cdc_order_wide": _with(HEADER, LINE, _CDC_USER, PROVINCE, _enriched_headers("h." + _INSERTED)) + _WIDE,
    "cdc_order_wide_as_of": _with(HEADER, LINE, USER.replace("users AS", "users_loaded AS"), _CDC_USER, PROVINCE, _AS_OF) + _WIDE,
    "order_unmatched": _with(HEADER) + """
SELECT id, user_id, create_time FROM headers h
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = h.id)""",
    "order_pairs": _with(HEADER, LINE) + f"""
SELECT coalesce(h.id, l.order_id) AS order_id, h.id AS header_id, l.id AS detail_id
FROM (SELECT * FROM headers WHERE {_INSERTED}) h FULL OUTER JOIN lines l ON l.order_id = h.id""",
    "order_waiting_lines": _with(HEADER, LINE) + f"""
SELECT l.id, l.order_id, l.sku_id, l.order_price FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.id = l.order_id AND h.{_INSERTED})""",
}

ORDERS["order_waiting_stream"] = ORDERS["order_waiting_lines"]

ORACLE = {**LOG, **CHANGES, **DAU, **ORDERS}
