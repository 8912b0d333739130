"""Local time: weekly opening hours and staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def schedule_state(ts_utc: Column, zone: str, weekdays: tuple[int, ...], opens: str, closes: str, verified: str, fresh_days: int) -> Column:
    """stale after the verified date plus so many days; else open on the weekdays (Monday 0) from opening to closing time, both included; else closed."""
    t = local(ts_utc, zone)
    clock = F.date_format(t, "HH:mm:ss.SSSSSS")
    is_open = F.weekday(t).isin(*weekdays) & clock.between(f"{opens}:00.000000", f"{closes}:00.000000")
    return F.when(F.to_date(t) > F.date_add(F.to_date(F.lit(verified)), fresh_days), "stale").when(is_open, "open").otherwise("closed")


def run_state(status: Column, started: Column, now: Column, most_seconds: int, alive: Column) -> Column:
    """State of a run: an ended one keeps its status; a running one past its time is timed_out, one whose process is gone orphaned."""
    late = F.unix_timestamp(now) - F.unix_timestamp(started) > most_seconds
    return F.when(status != "running", status).when(F.coalesce(late, F.lit(False)), "timed_out").when(~F.coalesce(alive, F.lit(False)), "orphaned").otherwise("running")
