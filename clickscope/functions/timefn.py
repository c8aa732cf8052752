"""Time expressions on ``TIMESTAMP_NTZ``: independent of the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_literal(value: datetime | str) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (wall clock, no zone)."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def local_datetime(epoch_col: Column | str, offset_hours: int = 8, tz_mode: str = "fixed",
                   time_zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds -> naive local datetime.

    ``fixed``: UTC plus a constant offset.  ``zone``: UTC converted with the rules of
    ``time_zone`` (daylight saving, historical offsets)."""
    c = F.col(epoch_col) if isinstance(epoch_col, str) else epoch_col
    if tz_mode == "fixed":
        return F.timestamp_add("SECOND", c + F.lit(offset_hours * 3600), F.expr(_EPOCH_NTZ))
    if tz_mode == "zone":
        utc_wall = F.timestamp_add("SECOND", c, F.expr(_EPOCH_NTZ))
        return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc_wall)
    raise ValueError(f"unknown tz_mode {tz_mode!r}")


def epoch_seconds(ntz_col: Column | str) -> Column:
    """Whole epoch seconds (floor) of a naive UTC wall-clock timestamp, computed from
    its calendar fields so the session zone never enters."""
    c = F.col(ntz_col) if isinstance(ntz_col, str) else ntz_col
    return (
        F.unix_date(F.to_date(c)).cast("long") * F.lit(86400)
        + F.hour(c).cast("long") * 3600
        + F.minute(c).cast("long") * 60
        + F.second(c).cast("long")
    )


def date_string(dt: Column | str) -> Column:
    return F.date_format(dt, "yyyy-MM-dd")


def datetime_string(dt: Column | str) -> Column:
    return F.date_format(dt, "yyyy-MM-dd HH:mm:ss")


def hour_of(dt: Column | str) -> Column:
    return F.hour(dt).cast("tinyint")


def weekday_monday0(dt: Column | str) -> Column:
    """Monday = 0 .. Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(dt).cast("tinyint")


def epoch_micros(ntz_col: Column | str) -> Column:
    """Epoch microseconds of a naive UTC wall-clock timestamp, from its calendar fields
    (seconds with their fraction), so the session zone never enters."""
    c = F.col(ntz_col) if isinstance(ntz_col, str) else ntz_col
    whole = F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000) + (
        F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    ) * F.lit(1_000_000)
    return whole + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")


def elapsed_days(start: Column | str, end: datetime) -> Column:
    """Whole elapsed days from ``start`` to the instant ``end``, floored, clipped at 0
    (a purchase at 10:00 the day before ``end`` gives 0, where ``datediff`` gives 1)."""
    end_us = int((end - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    days = F.floor((F.lit(end_us) - epoch_micros(start)) / F.lit(86_400_000_000))
    return F.greatest(days, F.lit(0)).cast("long")
