"""What several operators share: the folder for written tables, and texts as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; a word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where it is unset and Spark runs in one process, as in tests, a temporary folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and any executor can be lost."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables that one operator writes, by name, under a folder of its own in the shared one; each is deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def discard(self, *names: str) -> None:
        for name in names:
            discard(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        discard(self.spark, self.folder)


def _bucket(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def parted(df: DataFrame, key: str, wanted: DataFrame, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be among those of `wanted`, rows whose key is not).

    Keys are compared by hash bucket; at most 2^bits numbers go to all tasks, whatever the size of `wanted`. So a join
    that follows moves few rows of df where few are wanted, and all of them in the worst case.
    """
    few = F.broadcast(wanted.select(_bucket(F.col(key), bits).alias("__bucket")).distinct())
    df = df.withColumn("__bucket", _bucket(F.col(key), bits))
    return df.join(few, "__bucket", "left_semi").drop("__bucket"), df.join(few, "__bucket", "left_anti").drop("__bucket")


def salts_for(rows: int) -> int:
    """Salts for numbered(): one for each 200,000 rows, 64 at least."""
    return max(64, rows // 200_000)


def numbered(rows: DataFrame, group: str, salt: Column, into: str, salts: int) -> DataFrame:
    """rows with numbers 0.. without gaps in each group (not null); a large group is numbered by many tasks.

    The order within a salt is that of all columns, so a task that is run again gives the same numbers: only rows that
    agree in every column may change places. Columns must be of types that can be ordered; `salt` must come from them.
    """
    order = rows.columns
    rows = rows.withColumn("__salt", F.pmod(salt, F.lit(salts)))
    sizes = rows.groupBy(group, "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__salt")) - F.col("__n")  # over at most `salts` rows
    sizes = sizes.select(group, "__salt", before.alias("__before"))
    rows = rows.withColumn("__own", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order)) - 1)
    return rows.join(sizes, [group, "__salt"]).withColumn(into, F.col("__before") + F.col("__own")).select(*order, into)


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names (in any case) renamed, and what gives a frame made of them docs' columns under their own names."""
    other = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    columns = [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(other), lambda out: out.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
