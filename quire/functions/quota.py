"""Days, pacing and backoff of metered keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed


def quota_day(ts: Column, zone: str = fixed.ZONE) -> Column:
    """The day that a UTC time belongs to where quotas reset."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def seconds_to_reset(ts: Column, zone: str = fixed.ZONE) -> tuple[Column, Column]:
    """(wall-clock, elapsed) seconds to the next local midnight; they differ on days when clocks change."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    wall = 86400 - (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local))
    midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(F.to_date(local), 1).cast("timestamp_ntz"))
    return wall.cast("long"), F.timestamp_diff("SECOND", ts.cast("timestamp_ntz"), midnight)


def whole_hours(seconds: Column) -> Column:
    return F.floor(seconds / 3600).cast("long")


def latency_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two times in seconds."""
    return F.floor((ended - started) * 1000).cast("long")


def spacing(rpm: Column) -> Column:
    """Seconds between requests; none for a limit of zero or less."""
    return F.when(rpm <= 0, 0.0).otherwise(60.0 / rpm)


def remaining(rpd: Column, used: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), (rpd - used).cast("long"))


def backoff(retry_after: Column, refusals: Column) -> Column:
    """What the server asks for, else linear in the refusals in a row; zero counts as not given."""
    return F.least(F.lit(fixed.MAX_BACKOFF), F.coalesce(F.nullif(retry_after, F.lit(0.0)), fixed.BACKOFF * refusals))


def available_at(enabled: Column, state: Column, used: Column, rpd: Column, cooldown_until: Column, last_used_at: Column, rpm: Column) -> Column:
    """Earliest time of use; null if the key can't be used today."""
    never = ~enabled | state.isin("dead", "exhausted") | (used >= rpd)
    return F.when(~never, F.greatest(cooldown_until, last_used_at + spacing(rpm)))
