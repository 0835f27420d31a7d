"""Hand-made nested event rows for edge-case tests."""

from __future__ import annotations

import datetime as dt

from clickfold.schema import EVENT_SCHEMA

AS_OF = dt.date(2024, 1, 30)
EPOCH = dt.datetime(1970, 1, 1)
NO_SESSION = object()


def at(day: int, hour: int = 12, minute: int = 0, second: int = 0) -> dt.datetime:
    """A UTC time in January 2024."""
    return dt.datetime(2024, 1, day, hour, minute, second)


def micros(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def item(item_id, name, price, qty, revenue=None):
    return (item_id, name, price, qty, revenue)


def ev(user, t, name, sid=1000, *, params=None, items=None, user_id=None, kind=None,
       revenue=None, traffic=(None, None, None), geo=None):
    """One export row. `sid=None` gives no ga_session_id parameter;
    `params` is a dict key -> str | int | list of (str|int) for repeats."""
    plist = []
    if sid is not None:
        plist.append(("ga_session_id", (None, sid)))
    for k, v in (params or {}).items():
        for x in (v if isinstance(v, list) else [v]):
            plist.append((k, (x, None) if isinstance(x, str) else (None, x)))
    date = t.strftime("%Y%m%d")
    return (
        micros(t), name, plist, user_id, user, list(items or []), (revenue,), tuple(traffic),
        tuple(geo or (None,) * 6), date, kind or ("intraday" if t.date() == AS_OF else "daily"),
    )


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
