"""Time helpers: epoch milliseconds (S5) and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds -> naive UTC timestamp, independent of session zone."""
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_micros(ts: Column) -> Column:
    """Naive UTC timestamp -> microseconds since the epoch, independent of the
    session time zone (built from the day number and the wall-clock fields,
    so no zone or daylight-saving rule enters)."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    micros_in_minute = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + minutes * 60_000_000 + micros_in_minute


def epoch_millis(ts: Column) -> Column:
    """Naive UTC timestamp -> whole milliseconds since the epoch (floor)."""
    return F.floor(epoch_micros(ts) / 1000).cast("bigint")


def time_parts(ts: Column) -> dict[str, Column]:
    """Year, month, day, full day name, hour."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
    }
