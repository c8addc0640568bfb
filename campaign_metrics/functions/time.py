"""Time expressions: parsing to UTC, ISO output, buckets, zone shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaign_metrics.schema import MINUTE_BUCKET_WINDOW_MINUTES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(value: str) -> Column:
    """A fixed instant (UTC wall time) as timestamp_ntz, e.g. the ``now`` parameter."""
    return F.lit(value).cast("timestamp_ntz")


def parse_utc(c, on_bad: str = "reject") -> Column:
    """Text -> UTC wall time. An offset in the text is honoured, none means UTC.

    ``on_bad='reject'`` gives NULL for junk (the CSV rule drops the row);
    ``on_bad='fail'`` raises (the feed rule fails the page).
    Requires the session zone to be UTC (see ``session.ensure_utc``).
    """
    text = F.trim(_col(c).cast("string"))
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    if on_bad == "fail":
        return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(
            F.raise_error(F.concat(F.lit("unparseable timestamp: "), text)).cast("timestamp_ntz"))
    return parsed


def iso_seconds(c) -> Column:
    """ISO-8601 with offset, no fractions: 2026-03-09T03:36:12+00:00 (the key format)."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def floor_to(unit: str, c) -> Column:
    """date_trunc that stays timestamp_ntz."""
    return F.date_trunc(unit, _col(c)).cast("timestamp_ntz")


def bucket_size(is_live, starts_at, now: Column,
                window_minutes: int = MINUTE_BUCKET_WINDOW_MINUTES) -> Column:
    """Live campaigns use minute buckets before the start and during the first
    ``window_minutes``; every other case uses hours. One value per campaign."""
    starts_at = _col(starts_at)
    young = now < starts_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(window_minutes), F.lit(0))
    return F.when(_col(is_live) & starts_at.isNotNull() & young, F.lit("minute")).otherwise(F.lit("hour"))


def chart_time(is_live, created_at="created_at", timestamp_utc="timestamp_utc") -> Column:
    """Live campaigns chart by first-ingest time, others by activity time."""
    return F.when(_col(is_live), _col(created_at)).otherwise(_col(timestamp_utc))


def bucket(size_col, t) -> Column:
    """Bucket start for a per-row bucket size ('minute' or 'hour')."""
    return F.when(_col(size_col) == "minute", floor_to("minute", t)).otherwise(floor_to("hour", t))


def wall_to_utc(c, zone: str) -> Column:
    """Wall time in ``zone`` -> UTC wall time."""
    return F.to_utc_timestamp(_col(c).cast("timestamp"), zone).cast("timestamp_ntz")


def utc_to_wall(c, zone: str) -> Column:
    """UTC wall time -> wall time in ``zone``."""
    return F.from_utc_timestamp(_col(c).cast("timestamp"), zone).cast("timestamp_ntz")


def minutes_until(now: Column, t) -> Column:
    """Whole minutes from ``now`` until ``t`` (floor of the difference)."""
    secs = F.unix_timestamp(_col(t).cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    return F.floor(secs / 60).cast("long")
