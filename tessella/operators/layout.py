"""How rows lie over the cluster before work that is heavy for each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.store import workspace


def dealt(rows: DataFrame) -> DataFrame:
    """A table as it is read, over as many partitions as there are cores, where it arrives in fewer: one small file is read by a few
    tasks, and functions of whole texts would run there alone. A table in more splits stays where it lies, so a large one is never
    shuffled for this. Not for the result of joins or aggregations, which counting the partitions would run."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their number from 1 on in an order of the whole table, without a task that holds it: sorted ranges are written once, and
    each one's first number is what the ones before it count. Rows that tie in the order are numbered as they come."""
    spark, path = rows.sparkSession, workspace(rows.sparkSession)
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())  # range << 33 | place
    laid.write.parquet(path)
    held = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    place = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return held.join(F.broadcast(firsts), "_range").withColumn(name, place + F.col("_before") + 1).drop("_at", "_range", "_before")
