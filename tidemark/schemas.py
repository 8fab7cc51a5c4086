"""Record schemas and the other values every job has to agree on.

Field names, spellings and topic names are part of the data contract: producers and readers of
the topics and tables match on them.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def record(**fields) -> StructType:
    """A schema of nullable fields, in the order given."""
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


def strings(*names: str) -> StructType:
    """A schema whose members are all read as text."""
    return record(**{name: StringType() for name in names})


S, L, D, I = StringType(), LongType(), DoubleType(), IntegerType()

# ---- fixed values: topics ---------------------------------------------------------------------
BASE_LOG_TOPIC = "ODS_BASE_LOG"
CHANGE_TOPIC = "TOPIC_DB"
ERROR_TOPIC = "DWD_ERROR_LOG"
START_TOPIC = "DWD_START_LOG"
PAGE_TOPIC = "DWD_PAGE_LOG"
ACTION_TOPIC = "DWD_PAGE_ACTION_LOG"
DISPLAY_TOPIC = "DWD_PAGE_DISPLAY_LOG"
ORDER_INFO_TOPIC = "DWD_ORDER_INFO_I"
ORDER_DETAIL_TOPIC = "DWD_ORDER_DETAIL_I"
FACT_TOPIC_PREFIX = "DWD"
DIM_KEY_PREFIX = "DIM"

# Topics of this library's own: rejected input, order lines that no header came for, and order headers after enrichment.
REJECTED_LOG_TOPIC = "ODS_BASE_LOG_REJECTED"
REJECTED_CHANGE_TOPIC = "TOPIC_DB_REJECTED"
REJECTED_PAGE_TOPIC = "DWD_PAGE_REJECTED"
REJECTED_ORDER_TOPIC = "DWD_ORDER_REJECTED"
LATE_ORDER_TOPIC = "DWD_ORDER_LATE"
EXPIRED_LINE_TOPIC = "DWD_ORDER_DETAIL_EXPIRED"
ENRICHED_ORDER_TOPIC = "DWD_ORDER_INFO_ENRICHED"

# ---- fixed values: result tables --------------------------------------------------------------
DAU_INDEX = "mall_dau"
ORDER_INDEX = "mall_order"
HOUR_BUCKETS = 30
ORDER_WAIT_HOURS = 24

# ---- fixed values: dimension tables -----------------------------------------------------------
USER_TABLE = "user_info"
PROVINCE_TABLE = "base_province"

# ---- fixed values: change types -> operation letter -------------------------------------------
CHANGE_OPS = {
    "bootstrap-insert": "I",
    "insert": "I",
    "update": "U",
    "delete": "D",
}
OTHER_OP = "O"

# ---- fixed values: log members, JSON name -> column name --------------------------------------
COMMON_MEMBERS = {
    "ar": "province_id",
    "ba": "brand",
    "ch": "channel",
    "is_new": "is_new",
    "md": "model",
    "mid": "mid",
    "os": "operate_system",
    "uid": "user_id",
    "vc": "version_code",
}
PAGE_MEMBERS = {
    "during_time": "during_time",
    "item": "page_item",
    "item_type": "page_item_type",
    "last_page_id": "last_page_id",
    "page_id": "page_id",
    "source_type": "source_type",
}
START_MEMBERS = {
    "entry": "entry",
    "loading_time": "loading_time",
    "open_ad_id": "open_ad_id",
    "open_ad_ms": "open_ad_ms",
    "open_ad_skip_ms": "open_ad_skip_ms",
}
ACTION_MEMBERS = {
    "action_id": "action_id",
    "item": "action_item",
    "item_type": "action_item_type",
}
DISPLAY_MEMBERS = {
    "display_type": "display_type",
    "item": "display_item",
    "item_type": "display_item_type",
    "order": "display_order",
    "pos_id": "display_pos_id",
}
LONG_COLUMNS = {"during_time", "loading_time", "open_ad_ms", "open_ad_skip_ms"}


def _columns(*members: dict[str, str]) -> StructType:
    names = [column for group in members for column in group.values()]
    return record(**{n: (L if n in LONG_COLUMNS else S) for n in names}, ts=L)


START_LOG = _columns(COMMON_MEMBERS, START_MEMBERS)
PAGE_LOG = _columns(COMMON_MEMBERS, PAGE_MEMBERS)
ACTION_LOG = _columns(COMMON_MEMBERS, PAGE_MEMBERS, ACTION_MEMBERS)
DISPLAY_LOG = _columns(COMMON_MEMBERS, PAGE_MEMBERS, DISPLAY_MEMBERS)

ACTION_ARRAY = ArrayType(strings(*ACTION_MEMBERS))
DISPLAY_ARRAY = ArrayType(strings(*DISPLAY_MEMBERS))

# ---- fixed values: result records -------------------------------------------------------------
DAU_INFO = record(
    mid=S, user_id=S, province_id=S, channel=S, is_new=S, model=S, operate_system=S,
    version_code=S, page_id=S, page_item=S, page_item_type=S, during_time=L,
    user_gender=S, user_age=S,
    province_name=S, province_iso_code=S, province_3166_2=S, province_area_code=S,
    dt=S, hr=S, ts=L,
)

ORDER_INFO = record(
    id=L, province_id=L, order_status=S, user_id=L,
    total_amount=D, activity_reduce_amount=D, coupon_reduce_amount=D,
    original_total_amount=D, feight_fee=D, feight_fee_reduce=D,
    expire_time=S, refundable_time=S, create_time=S, operate_time=S,
)
ORDER_INFO_DERIVED = record(
    create_date=S, create_hour=S,
    province_name=S, province_area_code=S, province_3166_2_code=S, province_iso_code=S,
    user_age=I, user_gender=S,
)
ORDER_INFO_ENRICHED = StructType(ORDER_INFO.fields + ORDER_INFO_DERIVED.fields)

ORDER_DETAIL = record(
    id=L, order_id=L, sku_id=L, order_price=D, sku_num=L, sku_name=S, create_time=S,
    split_total_amount=D, split_activity_amount=D, split_coupon_amount=D,
)

# Amounts that count as 0 when the record leaves them out.
ZERO_BY_DEFAULT = {
    "total_amount", "activity_reduce_amount", "coupon_reduce_amount",
    "original_total_amount", "feight_fee", "feight_fee_reduce",
    "split_total_amount", "split_activity_amount", "split_coupon_amount",
}

_detail_part = [f for f in ORDER_DETAIL if f.name not in ("id", "order_id", "create_time")]
_info_part = [f for f in ORDER_INFO_ENRICHED if f.name != "id"]
ORDER_WIDE = StructType(
    [StructField("detail_id", L), StructField("order_id", L)] + _detail_part + _info_part
)

USER_DIM = record(id=S, gender=S, birthday=S)
PROVINCE_DIM = record(id=S, name=S, iso_code=S, iso_3166_2=S, area_code=S)
DIM_ROW = record(dim_table=S, dim_key=S, id=S, op=S, data=S)
