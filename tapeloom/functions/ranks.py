"""Exact ranks and medians of groups too large for one task.

A plain `rank()` window puts a whole group into one task. Here equal values are counted together, and the distinct (group, value)
pairs are put in order by one range partitioning: every slice of that order is numbered on its own, and the counts of a group's
earlier slices are added as an offset. A group holding a third of all rows spreads over a third of the slices, whatever its values.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import staged


def positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value): n, rows before it, and rows in the group."""
    known = df.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    counted = known.groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Slices are fixed when they are written: numbering and offsets read the same ones.
    sliced = staged(counted.repartitionByRange(parts, *keys, value).withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_size"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))   # as many rows as a group fills slices
    lower = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_offset"), F.sum("_size").over(group).alias("total"))
    return (local.join(offsets, [*keys, "_slice"])
            .select(*keys, value, "n", (F.col("_local") + F.col("_offset")).alias("before"), "total"))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the rank with ties averaged (1 = smallest); NULL values get none."""
    ranks = positions(df, keys, value).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Median of each group as the mean of its middle order statistics."""
    placed = positions(df, keys, value)
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)

    def at(k):
        return F.max(F.when((F.col("before") < k) & (k <= F.col("before") + F.col("n")), F.col(value)))
    middle = placed.groupBy(*keys).agg(at(low).alias("_a"), at(high).alias("_b"))
    return middle.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(out))
