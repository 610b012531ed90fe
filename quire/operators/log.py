"""The event log, settings and schema migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed


def tail(events: DataFrame, after_id: int = 0, limit: int = 200, key: str = "id") -> DataFrame:
    """The newest ``limit`` (1 to 1000) events after a cursor, oldest first. A reader that falls further behind
    misses some; the streaming tail doesn't."""
    limit = max(1, min(limit, fixed.MOST_EVENTS))
    return events.filter(F.col(key) > after_id).orderBy(F.desc(key)).limit(limit).orderBy(key)


def trim(events: DataFrame, keep: int = fixed.KEPT_EVENTS, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the newest ``keep`` stay. Only their ids are sorted, and only the smallest is needed."""
    least = events.select(key).orderBy(F.desc(key)).limit(keep).agg(F.min(key).alias("__least"))
    bounded = events.crossJoin(F.broadcast(least))  # one row
    kept = bounded.filter(F.col(key) >= F.col("__least")).drop("__least")
    return kept, bounded.filter(F.col("__least").isNull() | (F.col(key) < F.col("__least"))).drop("__least")


def latest_settings(changes: DataFrame, secret_keys: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """key (and ``by``), value, updated_at of the latest change (by ``seq``) of each setting; a blank value never replaces a secret."""
    counts = ~(F.col("key").isin(*secret_keys) & (F.trim(F.coalesce("value", F.lit(""))) == "")) if secret_keys else F.lit(True)
    return changes.filter(counts).groupBy(*by, "key").agg(F.max_by(F.struct("value", "updated_at"), "seq").alias("s")).select(*by, "key", "s.*")


def migrated(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that aren't there yet, with their defaults; nothing is changed or dropped."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in wanted.items() if c.lower() not in have})


def append(events: DataFrame, path: str) -> None:
    """Adds events to the log's table."""
    events.write.mode("append").parquet(path)
