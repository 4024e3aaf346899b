"""Packing rows into a size budget, per group, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """The longest prefix of each key's rows that fits; the first row is always kept."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("used", F.sum(size).over(upto)).withColumn("_at", at).where((F.col("used") <= most) | (F.col("_at") == 1)).drop("_at")


def skip_within(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Each key's rows in order, leaving out any that no longer fits and going on: key, used, picked (orders).

    The running choice is a fold over the key's sizes; only (order, size) pairs are collected.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("picked"))
    fits = lambda a, x: a["used"] + x["s"] <= most
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["picked"], F.array(x["o"])).alias("picked"))).otherwise(a)
    return df.groupBy(key).agg(F.aggregate(pairs, zero, step).alias("r")).select(key, "r.*")
