"""How many rows a statement has changed, counted while they are written: no second job, no second evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what its first action will have seen: ``rows``, and for each name the rows for which its condition holds.
    ``observation.get`` waits for that action."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen
