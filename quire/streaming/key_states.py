"""Key states as a stream: the same transitions as the batch fold in ``operators/keys.py``, with timers for what time alone
changes: at the quota day's midnight usage is cleared and a spent key is back, a cooldown ends when it is over, and a key
that has had a whole day without outcomes and would begin as it is now is forgotten.

Timers go by the watermark, so a stream that is run again gives the same rows; with ``processing`` they go by the clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions import fixed, quota
from quire.functions.text import has_any


class Key(NamedTuple):
    state: str = "active"
    used_on: str = ""
    used_today: int = 0
    rpd_limit: int = fixed.RPD
    refusals: int = 0
    cooldown_until: float = 0.0
    last_used_at: float = 0.0
    last_error: str = ""


STATE = "state string, used_on string, used_today long, rpd_limit long, refusals int, cooldown_until double, last_used_at double, last_error string"
#: ``seq``: the key's last outcome; ``at``: when it changed; ``why``: outcome, midnight, cooldown or forgotten.
OUT = f"key_id long, seq long, at double, why string, {STATE}"


def on_day(key: Key, day: str) -> Key:
    if key.used_on == day:
        return key
    revived = key.state == "exhausted"
    return key._replace(used_on=day, used_today=0, refusals=0, state="active" if revived else key.state, last_error="" if revived else key.last_error)


def advance(key: Key, outcome: str, ts: float, day: str, daily: bool = False, message: str = "", retry_after: float | None = None, rpd: int | None = None) -> Key:
    """A key after one outcome."""
    by_hand = outcome in ("revive", "edit")
    if key.state == "dead" and not by_hand:
        return key
    key = on_day(key, day)
    if not by_hand:
        key = key._replace(last_used_at=max(key.last_used_at, ts))
    if outcome == "success":
        key = key._replace(used_today=key.used_today + 1, refusals=0, last_error="")
        return key._replace(state="exhausted", last_error=fixed.SPENT) if key.used_today >= key.rpd_limit else key
    if outcome == "rate_limited":
        key = key._replace(refusals=key.refusals + 1)
        at_limit, refused = key.used_today >= key.rpd_limit, key.refusals >= fixed.REFUSALS
        if not (daily or at_limit or refused):
            wait = min(fixed.MAX_BACKOFF, retry_after or fixed.BACKOFF * key.refusals)
            return key._replace(state="cooldown", cooldown_until=ts + wait, last_error=fixed.WAITING.format(int(wait)))
        if refused and not at_limit and key.used_today >= fixed.LEARN_FROM:
            return key._replace(state="exhausted", rpd_limit=key.used_today, last_error=fixed.LEARNED.format(key.used_today))
        few = refused and not at_limit
        return key._replace(state="exhausted", last_error=fixed.PARKED.format(key.used_today) if few else fixed.SPENT)
    if outcome == "transient":
        return key._replace(state="cooldown", cooldown_until=ts + fixed.TRANSIENT_COOLDOWN, last_error=fixed.SERVER_ERROR.format((message or "")[:120]))
    if outcome == "dead":
        return key._replace(state="dead", last_error=fixed.REJECTED.format((message or "")[:200]))
    if outcome == "revive":
        return key._replace(state="active", refusals=0, cooldown_until=0.0, last_error="")
    if outcome == "edit":
        return key._replace(rpd_limit=int(rpd), state="active" if key.state == "exhausted" and key.used_today < rpd else key.state)
    return key


def expired(key: Key, now: float, day: str) -> Key:
    """A key at ``now`` without an outcome, as ``operators/keys.py:expire`` has it."""
    key = on_day(key, day)
    if key.state == "cooldown" and key.cooldown_until <= now:
        key = key._replace(state="active", last_error="")
    if key.state == "active" and key.used_today >= key.rpd_limit:
        key = key._replace(state="exhausted", last_error=fixed.SPENT)
    return key


def day_at(at: float, zone: str) -> tuple[str, float]:
    """The quota day of a time, and when the next one begins."""
    local = dt.datetime.fromtimestamp(at, ZoneInfo(zone))
    after = dt.datetime.combine(local.date() + dt.timedelta(days=1), dt.time(), ZoneInfo(zone))
    return local.date().isoformat(), after.timestamp()


class KeyDays(StatefulProcessor):
    """One key's state, and one timer: midnight, or the end of its cooldown if that is before."""

    def __init__(self, rpd_limit: int, zone: str):
        self.rpd_limit, self.zone = rpd_limit, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("key", f"seq long, {STATE}")

    def _now(self) -> tuple[int, Key]:
        if not self.kept.exists():
            return -1, Key(rpd_limit=self.rpd_limit)
        seq, *rest = self.kept.get()
        return seq, Key(*rest)

    def _keep(self, seq: int, key: Key, at: float) -> None:
        self.kept.update((seq, *key))
        _, midnight = day_at(at, self.zone)
        due = min([midnight, *([key.cooldown_until] if key.state == "cooldown" and key.cooldown_until > at else [])])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-int(-due * 1000 // 1))

    def _row(self, key_id: int, seq: int, at: float, why: str, key: Key) -> pd.DataFrame:
        return pd.DataFrame([(key_id, seq, at, why, *key)], columns=["key_id", "seq", "at", "why", *Key._fields])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        own = Key(*[r[c] if not isinstance(t, int) else int(r[c]) for c, t in zip(Key._fields, Key(), strict=True)])
        self._keep(int(r["seq"]), own, float(r["at"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, now = self._now()
        at = 0.0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = advance(now, r.outcome, r.at, r.day, bool(r.daily), r.message, None if pd.isna(r.retry_after) else r.retry_after, None if pd.isna(r.rpd) else int(r.rpd))
            seq, at = r.seq, max(at, r.at)
        self._keep(seq, now, at)
        yield self._row(key[0], seq, at, "outcome", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, before = self._now()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        day, _ = day_at(at, self.zone)
        ended, _ = day_at(at - 1, self.zone)
        now = expired(before, at, day)
        idle = day_at(before.last_used_at, self.zone)[0] < ended
        if ended != day and idle and now._replace(used_on="", last_used_at=0.0, cooldown_until=0.0) == Key(rpd_limit=self.rpd_limit):
            self.kept.clear()
            yield self._row(key[0], seq, at, "forgotten", now)
            return
        self._keep(seq, now, at)
        yield self._row(key[0], seq, at, "midnight" if ended != day else "cooldown", now)


def key_states(outcomes: DataFrame, rpd_limit: int = fixed.RPD, late: str = "1 hour", zone: str = fixed.ZONE, initial: DataFrame | None = None, processing: bool = False) -> DataFrame:
    """Stream of each key's state whenever it changes: once a micro-batch that has outcomes of it, and at its timers. ``outcomes``:
    key_id, seq, ts, outcome, message, retry_after, rpd; those later than ``late`` behind the newest are dropped. ``initial``: key_id, seq, at and a
    state, as a batch has folded them, to go on from. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    at = F.col("ts").cast("timestamp")
    day = quota.quota_day(F.col("ts").cast("timestamp_ntz"), zone).cast("string")
    rows = outcomes.select(at.alias("event_at"), "key_id", "seq", (F.unix_micros(at) / 1e6).alias("at"), day.alias("day"), has_any(F.col("message"), fixed.DAILY_MARKERS).alias("daily"), "outcome", "message", "retry_after", "rpd")
    rows = rows if processing else rows.withWatermark("event_at", late)
    begun = None if initial is None else initial.select("key_id", "seq", "at", *[F.col(c).cast("string").alias(c) if c == "used_on" else F.col(c) for c in Key._fields]).groupBy("key_id")
    return rows.groupBy("key_id").transformWithStateInPandas(KeyDays(rpd_limit, zone), OUT, "Update", "ProcessingTime" if processing else "EventTime", begun)
