"""Explicit schemas. Nothing is inferred: a `YYYYMMDD` partition folder
would be read as an int by inference, so the export is always read with
EVENT_SCHEMA."""

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_D = T.DoubleType()
_I = T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PARAM_VALUE = _struct(("string_value", _S), ("int_value", _L))
EVENT_PARAM = _struct(("key", _S), ("value", PARAM_VALUE))
ITEM = _struct(
    ("item_id", _S), ("item_name", _S), ("price", _D), ("quantity", _L), ("item_revenue", _D)
)
ECOMMERCE = _struct(("purchase_revenue", _D))
TRAFFIC_SOURCE = _struct(("source", _S), ("medium", _S), ("name", _S))
GEO = _struct(
    ("continent", _S), ("sub_continent", _S), ("country", _S),
    ("region", _S), ("city", _S), ("metro", _S),
)

# One row per event. `event_date` (the shard date, YYYYMMDD) and
# `export_kind` ('daily' | 'intraday') are the partition folders.
EVENT_SCHEMA = _struct(
    ("event_timestamp", _L),
    ("event_name", _S),
    ("event_params", T.ArrayType(EVENT_PARAM, True)),
    ("user_id", _S),
    ("user_pseudo_id", _S),
    ("items", T.ArrayType(ITEM, True)),
    ("ecommerce", ECOMMERCE),
    ("traffic_source", TRAFFIC_SOURCE),
    ("geo", GEO),
    ("event_date", _S),
    ("export_kind", _S),
)
PARTITION_COLUMNS = ("event_date", "export_kind")

# Account-side buyer flags, keyed by the numeric account id.
BUYER_SCHEMA = _struct(("const_id", _L), ("new", _I), ("renew", _I), ("lapsed", _I))

# Mailing statistics as delivered by the e-mail platform: all text.
CAMPAIGN_METRICS = (
    "send_amt", "opens", "uniqueopens", "linkclicks", "uniquelinkclicks",
    "subscriberclicks", "forwards", "uniqueforwards", "hardbounces", "softbounces",
    "unsubscribes", "unsubreasons", "replies", "uniquereplies", "socialshares",
)
CAMPAIGN_SCHEMA = _struct(("name", _S), ("ldate", _S), *[(m, _S) for m in CAMPAIGN_METRICS])
