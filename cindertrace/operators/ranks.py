"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindertrace.operators.components import checkpointed


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row (from 1) among those of its keys, in an order that has no ties.

    Rows are dealt by ranges of keys and order, so a key may fill many tasks; each task numbers what it
    has, and the counts of the tasks before it are added (one row for each key and task).
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    held = checkpointed(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = held.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return held.join(parts, [*keys, "_task"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_task", "_at", "_first", "_before")


def running(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds the running sums of some columns in the order of a column without ties: {column: name of its sum}.

    Rows are dealt by ranges; each task adds up what it has, from the sums of the tasks before it (one row
    for each task).
    """
    held = checkpointed(rows.repartitionByRange(order).withColumn("_task", F.spark_partition_id()))
    parts = held.groupBy("_task").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier, so_far = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_task").orderBy(order)
    parts = parts.select("_task", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    out = held.join(F.broadcast(parts), "_task")
    return out.withColumns({name: F.sum(c).over(so_far) + F.col(f"_{c}") for c, name in sums.items()}).drop("_task", *[f"_{c}" for c in sums])
