"""Continuous runs as Structured Streaming: an incremental page pipeline, keyed state, a lossless log tail, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import quality


def run_pages(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_at_once: int = 100) -> None:
    """Processes the files that have arrived since the last run and ends. Each batch is written to a folder of its own,
    which a repeated batch overwrites: every page counts once, whatever fails in between."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def batch(df: DataFrame, n: int) -> None:
        process(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gated(pages: DataFrame) -> DataFrame:
    """A ``process`` for results: adds status and flag_reason."""
    return quality.gate(pages)


def refusal_runs(outcomes: DataFrame) -> DataFrame:
    """Stream of key_id, seq, outcome: each key's refusals in a row so far. State is one number a key."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        # a key's rows of one micro-batch, in order
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, outcome in zip(rows["seq"], rows["outcome"], strict=True):
            run = run + 1 if outcome == "rate_limited" else 0
            out.append((key[0], seq, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["key_id", "seq", "run"])

    return outcomes.groupBy("key_id").applyInPandasWithState(step, "key_id long, seq long, run int", "run int", "append", GroupStateTimeout.NoTimeout)


def tail_log(spark: SparkSession, source: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All log files that are new since the last call, in batches; unlike a newest-N poll it misses none."""
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Extension: counts in fixed windows; late rows are taken up to the watermark. Works on streams and tables."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: activity sessions of each key, closed by a gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
