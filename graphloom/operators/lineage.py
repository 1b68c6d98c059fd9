"""Cutting lineage in loops, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, on one machine, a temporary folder is made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Removes the shuffle files of a query when it is done; a table that was cut needs them no more.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, from which it is read again: computed once, and any executor may be lost."""
    at = f"{shared_dir(df.sparkSession)}/graphloom/cut-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more, as those of a loop's earlier rounds; of other tables nothing."""
    for df in tables:
        spark, mine = df.sparkSession, f"{shared_dir(df.sparkSession)}/graphloom/cut-"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            if re.sub("^file:/+", "/", folder).startswith(re.sub("^file:/+", "/", mine)):
                at.getFileSystem(conf).delete(at, True)


def numbered(names: DataFrame) -> DataFrame:
    """name, id of every distinct name: whole numbers in the order of the names, so that least names have least numbers."""
    ordered = names.select("name").distinct().repartitionByRange("name").sortWithinPartitions("name")
    return cut(ordered.withColumn("id", F.monotonically_increasing_id()))


def as_numbers(rows: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    """rows with names in some columns turned to their numbers, one column after another; each step's table goes when the next is there."""
    for c in columns:
        there = cut(rows.join(numbers.select(F.col("name").alias(c), F.col("id").alias("__id")), c).drop(c).withColumnRenamed("__id", c))
        drop(rows) if c != columns[0] else None
        rows = there
    return rows
