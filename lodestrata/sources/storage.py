"""Tables in the folder that driver and executors share: what is used twice is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few values up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Without the setting, a temporary folder takes its place on one machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestrata/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `bound` rows, else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
