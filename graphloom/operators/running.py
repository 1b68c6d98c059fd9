"""Running values over long groups, split: parts in range order, what is carried from part to part, and the rows of each part.

A window over a group puts the whole group into one task. Here rows are dealt out by ranges of (group, order), so a group with most rows
lies in many parts; each part is summed to a row for each of its groups, these few rows are scanned in order, and every
row gets the value carried into its part and its own running value within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def in_parts(rows: DataFrame, group: str, order: str, parts: int | None = None) -> DataFrame:
    """rows with the number of their range part, written, so that a part stays the same when a task is run again."""
    by = [F.col(group), F.col(order)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def versions(rows: DataFrame, group: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """rows with changed (the first of the group, or value differs from that before), version (changes so far) and latest (the group's last row).

    order is unique within a group; a null value is a value of its own. A null group is a group.
    """
    rows = in_parts(rows, group, order, parts)
    w = Window.partitionBy("part", group).orderBy(order)
    differs = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    local = rows.withColumn("first", F.row_number().over(w) == 1).withColumn("own", F.when(F.col("first"), 0).otherwise(differs.cast("int")))
    local = local.withColumns({"so_far": F.sum("own").over(w), "last": F.lead(F.lit(1)).over(w).isNull()})
    sums = local.groupBy("part", group).agg(F.sum("own").alias("n"), F.min_by(F.struct(F.col(value).alias("v")), order).alias("a"), F.max_by(F.struct(F.col(value).alias("v")), order).alias("b"))
    over = Window.partitionBy(group).orderBy("part")  # a row for each part of a group
    before = F.lag("b").over(over)
    sums = sums.withColumn("opens", F.when(before.isNull(), 1).otherwise((~before["v"].eqNullSafe(F.col("a.v"))).cast("int")))
    carried = F.sum(F.col("n") + F.col("opens")).over(over) - F.col("n")
    sums = sums.select(F.col("part").alias("__part"), F.col(group).alias("__group"), "opens", carried.alias("carried"), F.lead("part").over(over).isNull().alias("ends"))
    out = local.join(sums, (F.col("part") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    changed = F.when(F.col("first"), F.col("opens")).otherwise(F.col("own"))
    return out.select(*[c for c in rows.columns if c != "part"], (changed == 1).alias("changed"), (F.col("carried") + F.col("so_far")).cast("long").alias("version"), (F.col("last") & F.col("ends")).alias("latest"))


def with_total(rows: DataFrame, group: str) -> DataFrame:
    """rows with total, the number of rows of their group; a group is counted in all tasks and its one number joined back."""
    total = rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("total"))
    return rows.join(total, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
