"""Balanced contiguous shards by global byte-size prefix sums.

Documents are put in doc_id order by a range exchange of (doc_id, size, crc) - texts are never moved. Each range
partition is summed on its own; a running total over those few sums gives every partition its byte and row offset, so
that no task ever sees more than its own partition. A document goes to the shard whose equal byte target holds the
middle of the document.

Defined results: null text has size 1 and the crc of nothing; a null doc_id sorts first; repeated rows each keep a row;
an empty table gives no rows; other columns are dropped. One document larger than a shard's target leaves the
shards that it covers empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text)."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # The partition number is read by two queries, so it is written once: a second range exchange may cut elsewhere.
    ranged = stored(
        sized.repartitionByRange("doc_id", "text_crc32").withColumn("part", F.spark_partition_id()), "shards"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    own = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.join(F.broadcast(offsets), "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(own))
        .withColumn("index", F.col("rows_before") + F.count("*").over(own) - 1)
        .withColumn("middle", F.col("end") - F.col("size") / 2)
        .withColumn("shard", F.least(F.floor(F.col("middle") * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int"))
    )
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "index"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot")
    )
