"""Times, durations and local days. All timestamps are UTC; the session time zone must be UTC."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
EARLIEST, LATEST = "2000-01-01 00:00:00", "2100-01-01 00:00:00"


def moment(now: str | dt.datetime | Column) -> Column:
    """The caller's clock as a timestamp column."""
    if isinstance(now, Column):
        return now
    return F.lit(str(now)).cast("timestamp")


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def add_seconds(ts: Column, amount: Column | int) -> Column:
    """``ts`` moved by whole seconds, keeping it a timestamp."""
    step = F.lit(amount) if isinstance(amount, int) else amount
    return F.timestamp_seconds(F.unix_timestamp(ts) + step)


def is_plausible(ts: Column) -> Column:
    return F.coalesce((ts >= F.lit(EARLIEST).cast("timestamp")) & (ts < F.lit(LATEST).cast("timestamp")), F.lit(False))


def parse_time(text: Column) -> Column:
    """ISO text to a UTC timestamp; a text without zone is UTC, unreadable or implausible text gives null."""
    ts = F.try_to_timestamp(text)
    return F.when(is_plausible(ts), ts)


def epoch_time(text: Column) -> Column:
    """Epoch seconds written as text; implausible values give null."""
    number = text.try_cast("bigint")
    ts = F.timestamp_seconds(F.when(number.between(-62135596800, 253402300799), number))
    return F.when(is_plausible(ts), ts)


def recovery_time(r_eventid: Column, r_clock: Column, now: Column) -> Column:
    """Null while there is no recovery event, else its time, and ``now`` where that can not be read."""
    resolved = F.coalesce(F.trim(r_eventid), F.lit("0")).isin("0", "") == F.lit(False)
    return F.when(resolved, F.coalesce(epoch_time(r_clock), now))


def local_clock(ts: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm"), F.lit(DASH))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_start(day: Column, zone: str) -> Column:
    """UTC time at which the local day begins."""
    return F.to_utc_timestamp(day.cast("date").cast("timestamp"), zone)


def day_end(day: Column, zone: str) -> Column:
    return F.to_utc_timestamp(F.date_add(day.cast("date"), 1).cast("timestamp"), zone)


def in_local_day(ts: Column, day: str, zone: str) -> Column:
    at = F.lit(day)
    return F.coalesce((ts >= day_start(at, zone)) & (ts < day_end(at, zone)), F.lit(False))


def duration_text(value: Column) -> Column:
    """Seconds in words: s, min, h and min below 48 h, else days."""
    sec = F.greatest(F.lit(0), F.floor(value).cast("bigint"))
    minutes = F.floor(sec / 60)
    hours = F.floor(minutes / 60)
    rest = minutes % 60
    text = (F.when(sec < 60, F.concat(sec.cast("string"), F.lit(" s")))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
            .when(hours < 48, F.when(rest > 0, F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string"),
                                                        F.lit(" min")))
                  .otherwise(F.concat(hours.cast("string"), F.lit(" h"))))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" days"))))
    return F.when(value.isNull(), F.lit(DASH)).otherwise(text)


def time_to_recover(started: Column, resolved: Column) -> Column:
    return F.when(resolved.isNotNull(), F.greatest(F.lit(0).cast("bigint"), seconds(resolved) - seconds(started)))
