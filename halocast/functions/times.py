"""Observation times in their many encodings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from halocast.functions.geo import _col

# fixed values: text formats tried in order, each with the shape of text it fits
TEXT_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
]


def days_since_1950(days) -> Column:
    """Days (with a fraction) since 1950-01-01, to the second."""
    seconds = F.floor(_col(days) * 86400).cast("bigint")
    return F.to_timestamp_ntz(F.lit("1950-01-01")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def unix_time(seconds) -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01")) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.floor(_col(seconds)).cast("decimal(18,6)"))


def normalise_number(value, ruleset: str = "ultra") -> Column:
    """Numeric time.

    ``optimized``: 0 < v < 1e6 counts days since 1950. ``ultra``: above 1e9 unix
    seconds, above 10000 days since 1950. Anything else is null.
    """
    v = _col(value)
    if ruleset == "optimized":
        return F.when((v > 0) & (v < 1e6), days_since_1950(v))
    # years past 9999 cannot be a timestamp, so such day counts stay null
    return (F.when(v > 1e9, F.when(v < 253402300800.0, unix_time(v)))
            .when((v > 10000) & (v < 2940000.0), days_since_1950(v)))


def normalise_text(text) -> Column:
    """Timestamp written in one of the known formats, else null."""
    text = _col(text)
    tries = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
             for shape, fmt in TEXT_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def normalise_time(text, numeric: Column) -> Column:
    """Raw time text: a number where ``numeric`` says so, else a formatted text."""
    text = _col(text)
    return F.when(numeric, normalise_number(text.try_cast("double"))).otherwise(
        normalise_text(text))
