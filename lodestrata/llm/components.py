"""Connected components of links by label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp of links (a, b): comp is the smallest node that can be reached.

    Each round gives every node the smallest label among its own and its neighbours' (partial minima before the
    exchange, so a hub with many links is summed where its links are), then jumps to that label's own label. The labels
    of a round are written to the shared folder. Ends when no label changes; raises if that takes over max_rounds,
    rather than return labels that are not final.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "low").alias("low"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        new = stored(low.join(jump, "low", "left").select("node", F.least("low", "lower").alias("comp"), "was"), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
