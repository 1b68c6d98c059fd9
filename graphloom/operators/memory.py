"""The cycle of a memory: decay, dedup, promotion, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE, DECAY, COLD, HOT = "1 HOUR", 0.95, 0.5, 4.0


def decayed(items: DataFrame, now: Column) -> DataFrame:
    """items (h0, last, ...) with heat: what wasn't used for an hour cools."""
    idle = F.col("last") <= now - F.expr(f"INTERVAL {IDLE}")
    return items.withColumn("heat", F.when(idle, F.col("h0") * DECAY).otherwise(F.col("h0")))


def cycle(items: DataFrame, owner: str, pinned: Column, now: Column) -> DataFrame:
    """items (owner, kind, h0, last) with heat and state: archived, promoted, evicted or kept, in that order."""
    place = F.row_number().over(Window.partitionBy(owner, F.to_date("last")).orderBy(F.desc("heat"), "kind"))
    state = F.when(F.col("place") > 1, "archived").when(F.col("heat") >= HOT, "promoted").when((F.col("heat") < COLD) & ~pinned, "evicted").otherwise("kept")
    return decayed(items, now).withColumn("place", place).withColumn("state", state).drop("place")
