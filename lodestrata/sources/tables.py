"""Parquet tables of one folder as attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables(spark, folder).orders reads folder/orders.parquet; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")
