"""Event parameter lookup: in the `event_params` key/value array, in the
columns of shredded events (one struct per key, see `shred_params`), or in
columns that were looked up before (`look_up`)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickfold.functions._cache import per_context

_KINDS = {"string": "string_value", "int": "int_value"}
_strict = ContextVar("strict_params", default=False)
_shredded = ContextVar("shredded_params", default=False)
_looked_up = ContextVar("looked_up_params", default=False)
SHREDDED = "params"


@contextmanager
def strict_params(on: bool = True) -> Iterator[None]:
    """Reports built inside the block fail on an event that holds a looked-up
    key twice, as the source's scalar subquery does."""
    token = _strict.set(on)
    try:
        yield
    finally:
        _strict.reset(token)


@contextmanager
def shredded_params(on: bool = True) -> Iterator[None]:
    """Reports built inside the block read shredded events: the looked-up keys
    are columns, so a scan reads those it needs and no array."""
    token = _shredded.set(on)
    try:
        yield
    finally:
        _shredded.reset(token)


@contextmanager
def looked_up_params(on: bool = True) -> Iterator[None]:
    """Aggregates built inside the block read the columns of `look_up`."""
    token = _looked_up.set(on)
    try:
        yield
    finally:
        _looked_up.reset(token)


def look_up(*wanted: tuple[str, str], where: dict[str, Column] | None = None) -> list[Column]:
    """Parameters (key, kind) of an event as columns of their own, for the
    aggregates built inside `looked_up_params()`. Greatest or least texts are
    aggregated by sorting their input: so it is these few values that are
    sorted, not the event with its array. `where`: condition by key, for those
    that are looked at on some events only."""
    values = [event_param(k, kind) if k not in (where or {}) else F.when(where[k], event_param(k, kind)) for k, kind in wanted]
    return [v.alias(_looked_up_name(*w)) for v, w in zip(values, wanted, strict=True)]


def _looked_up_name(key: str, kind: str) -> str:
    return f"_{kind}_{key}"


def shred_params(keys: tuple[str, ...], params: str = "event_params") -> Column:
    """All entries of `keys` as one struct column, in one pass over the
    array: per key the first entry's values and the number of entries."""
    entry = "struct<string_value: string, int_value: bigint, n: int>"
    empty = F.struct(*[
        F.struct(F.lit(None).cast("string").alias("string_value"), F.lit(None).cast("bigint").alias("int_value"), F.lit(0).alias("n")).alias(k)
        for k in keys
    ])

    def add(held: Column, p: Column) -> Column:
        return F.struct(*[
            F.when(
                p["key"] == k,
                F.struct(
                    F.when(held[k]["n"] == 0, p["value"]["string_value"]).otherwise(held[k]["string_value"]).alias("string_value"),
                    F.when(held[k]["n"] == 0, p["value"]["int_value"]).otherwise(held[k]["int_value"]).alias("int_value"),
                    (held[k]["n"] + 1).alias("n"),
                ),
            ).otherwise(held[k]).cast(entry).alias(k)
            for k in keys
        ])

    typed = ", ".join(f"`{k}`: {entry}" for k in keys)
    return F.aggregate(F.coalesce(F.col(params), F.array().cast("array<struct<key: string, value: struct<string_value: string, int_value: bigint>>>")), empty.cast(f"struct<{typed}>"), add)


def event_param(key: str, kind: str = "string", *, strict: bool | None = None, params: str = "event_params") -> Column:
    """Value of parameter `key` of the row's event, NULL when absent.

    The position of the first entry with that key in the array of keys,
    then the value at that position: built-in array functions over the
    row's own array (no lambda, no join, no subquery). With `strict=True`,
    or inside `strict_params()`, a key present twice raises, as a scalar
    subquery would; by default the first entry wins.
    """
    if _looked_up.get():
        return F.col(_looked_up_name(key, kind))
    strict = _strict.get() if strict is None else strict
    return _shredded_param(key, kind, strict) if _shredded.get() else _event_param(key, kind, strict, params)


@per_context
def _event_param(key: str, kind: str, strict: bool, params: str) -> Column:
    field = _KINDS[kind]
    keys = F.col(params)["key"]
    at = F.array_position(keys, F.lit(key)).cast("int") - 1  # -1 when absent
    value = F.get(F.col(params)["value"][field], at)
    return _once(key, kind, F.size(keys) - F.size(F.array_remove(keys, F.lit(key))), value) if strict else value


@per_context
def _shredded_param(key: str, kind: str, strict: bool) -> Column:
    entry = F.col(SHREDDED)[key]
    return _once(key, kind, entry["n"], entry[_KINDS[kind]]) if strict else entry[_KINDS[kind]]


def _once(key: str, kind: str, occurrences: Column, value: Column) -> Column:
    error = F.raise_error(F.lit(f"event parameter '{key}' appears more than once"))
    return F.when(occurrences > 1, error.cast("string" if kind == "string" else "bigint")).otherwise(value)


def session_id() -> Column:
    """`ga_session_id` as bigint (NULL when the event has none)."""
    return event_param("ga_session_id", "int")


def session_id_concat() -> Column:
    """User id text followed by the session id; NULL when either is NULL."""
    return F.concat(F.col("user_pseudo_id"), session_id().cast("string"))


def session_engaged(int_fallback: bool = True) -> Column:
    """Per-event engaged flag as text: the string value, else the int value
    as text. `int_fallback=False` reads the string value only."""
    s = event_param("session_engaged", "string")
    if not int_fallback:
        return s
    return F.coalesce(s, event_param("session_engaged", "int").cast("string"))
