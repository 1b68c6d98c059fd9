"""Streams: an ingest queue that upserts, recovery of stale jobs, windowed usage, and heat kept in state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import cut


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def upsert(rows: DataFrame, target: str, key: str, newest: str, buckets: int = 256) -> None:
    """Keep the newest row of each key in a target partitioned by the key's hash: only the partitions of keys that came are read and rewritten.

    The rewrite replaces whole partitions when it commits, and the newest row is the newest again if it is repeated.
    """
    spark = rows.sparkSession
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy(key).agg(F.max_by(F.struct("*"), newest).alias("r")).select("r.*"))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    if exists(spark, target):
        had = spark.read.schema(rows.schema).parquet(target).filter(F.col("bucket").isin(touched))
        rows = rows.unionByName(had).groupBy(key).agg(F.max_by(F.struct("*"), newest).alias("r")).select("r.*")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert_queue(stream: DataFrame, target: str, key: str, newest: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Keep the newest row of each key in target, batch by batch; work follows the partitions that a batch touches."""
    return each_batch(stream, lambda rows, _: upsert(rows, target, key, newest, buckets), checkpoint)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand status changes to subscribers, batch by batch."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts and spending by type in event-time windows, with a watermark for late rows."""
    spent = F.sum(F.round("value", 2).cast("decimal(18,2)"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), spent.alias("spent")).select(F.col("window.start").alias("start"), "event_type", "n", "spent")


def running_heat(events: DataFrame, decay: float = 0.95) -> DataFrame:
    """user_id, heat after every batch: one for each event, times `decay` for each batch in between, kept as state."""

    def update(key, batches, state):
        heat = state.get[0] if state.exists else 0.0
        n = sum(len(b) for b in batches)
        heat = heat * decay + n
        state.update((heat,))
        yield pd.DataFrame({"user_id": [key[0]], "heat": [heat]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, heat double", "heat double", "update", "NoTimeout")


def recovered(jobs: DataFrame, now, stuck: str = "5 minutes", waiting: str = "10 minutes") -> DataFrame:
    """Jobs (status, since, held) that were in work, or waited without being held, for too long have failed."""
    age = lambda x: F.col("since") < now - F.expr(f"INTERVAL {x}")
    stale = ((F.col("status") == "processing") & age(stuck)) | ((F.col("status") == "pending") & age(waiting) & ~F.coalesce("held", F.lit(False)))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
