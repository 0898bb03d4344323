"""Scalar building blocks: missing values, hashing, rounding and event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ("exchange", "symbol")


def no_nan(c: Column) -> Column:
    """NaN and infinities become NULL.  Spark orders NaN above every number, so none may enter a comparison."""
    bad = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(~bad, c)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def event_time(origin: Column, received: Column) -> Column:
    """Origin time where it parses, else received time."""
    return F.coalesce(F.try_to_timestamp(origin), F.try_to_timestamp(received))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hash_unit(key: Column) -> Column:
    """A value in [0, 1) from the first eight hex digits of an md5: the same on every engine and every run."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def hash_below(key: Column, n: Column) -> Column:
    """A uniform integer in [0, n) for ``key``."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n)


def safe_ratio(num: Column, den: Column, floor: float = 1e-12) -> Column:
    return F.when(F.abs(den) >= floor, F.try_divide(num, den))


def utc_day(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def utc_month(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def add_columns(df, columns: dict[str, Column]):
    return df.withColumns(columns)
