"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (DataFrame functions only).

Every source has a target in tokens (words). Its documents, in an order shuffled by hash, form one stream that starts
again at its end; the stream is cut into blocks of equal tokens. Slot j of the mix has the golden-ratio point
frac((j + 1) / phi), which falls into the interval of one source in the cumulated targets; the r-th slot of a source
takes the r-th block of its stream, until the source's target is used up (the last block is cut there). Slots that the
sequence hands to a source beyond its target stay unused, and the few blocks that it leaves open follow at the end.

Scale: nothing is ranked or summed within a whole source. Streams are summed by (source, bin of the shuffle hash) and
slots are ranked by (source, chunk of slots); only the totals of bins and chunks are cumulated. There are as many bins
as a bin has rows, about, so both steps stay at the square root of the table and one source may hold any share of it; the
hash takes in the text, so rows with a null or repeated id spread like others. Points meet intervals in an equi-join on a
grid of [0, 1), not in a range or cross join.

Defined results: null text has size 0; documents of size 0 are never taken; sources order by code point with null last
(null is a source of its own); repeated rows are separate documents; an empty table gives no rows; a doc_id may be null.
All is a function of the rows, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored

PHI = 0.6180339887498949
#: Words of a block. Cells of the grid over [0, 1).
BLOCK, GRID = 4096, 4096


def n_words(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, target of sources (source, source_size); one row a source, so one task ranks them.

    The targets share the sum of sizes by weight, none above cap * size. Sharing the excess again until none is above
    ends at one water level t with sum(min(cap_i, w_i * t)) = total; in order of cap_i / w_i the level follows from
    running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full", F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    )
    # The first source whose ratio reaches its level is the first that is not capped; its level holds for all others.
    at = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)
    return ranked.select(
        "source", "source_size", F.least("most", F.col("weight") * F.coalesce(at["level"], F.lit(float("inf")))).alias("target")
    )


def _streams(sized: DataFrame, bins: int) -> DataFrame:
    """Adds `offset`: words of the source's stream before the document."""
    keyed = sized.withColumn("mixed", F.xxhash64(F.lit(17), "doc_id", "row")).withColumn(
        "bin", F.shiftrightunsigned("mixed", 34).cast("long") * bins / (1 << 30)
    )
    keyed = keyed.withColumn("bin", F.floor("bin"))
    per_bin = keyed.groupBy("src", "bin").agg(F.sum("size").alias("bin_size"))
    ahead = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.select("src", "bin", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0)).alias("bin_offset"))
    within = Window.partitionBy("src", "bin").orderBy("mixed", "doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(per_bin, ["src", "bin"]).withColumn(
        "offset", F.col("inner") + F.col("bin_offset")
    )


def schedule(goals: DataFrame, slots: int) -> DataFrame:
    """src, rank, slot: the slots 0 .. slots - 1 mapped through the cumulated targets and ranked per source."""
    so_far = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    shares = goals.withColumn("total", F.sum("target").over(Window.partitionBy())).where("total > 0 and target > 0")
    shares = shares.withColumn("high", F.sum("target").over(so_far) / F.col("total"))
    shares = shares.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("src")))
    cells = shares.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1))))
    ).select("src", "low", "high", "cell")
    spark = goals.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * PHI % 1).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * GRID)).withColumn("chunk", F.floor(F.col("slot") / (math.isqrt(slots) + 1)))
    drawn = points.join(cells, "cell").where("u >= low and u < high").select("src", "chunk", "slot")
    per_chunk = drawn.groupBy("src", "chunk").count()
    ahead = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("src", "chunk", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    return drawn.withColumn("inner", inner).join(per_chunk, ["src", "chunk"]).select(
        "src", (F.col("ahead") + F.col("inner")).alias("rank"), "slot"
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, first_slot.

    taken: words of the document in the mix, repeats counted; first_slot: the slot in which it first appears.
    """
    sized = stored(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("row")), "sized")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    order = Window.orderBy(F.col("source").isNull(), "source")
    goals = stored(goals.withColumn("src", F.row_number().over(order)).coalesce(1), "goals")
    facts = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    streams = _streams(
        sized.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, sized["source"].eqNullSafe(goals["source"]))
        .select("doc_id", "row", "size", "src", "source_size", "target"),
        math.isqrt(facts["n"]) + 1,
    )
    streams = stored(streams.drop("row").withColumn("row", F.monotonically_increasing_id()), "streams")
    # A pass of the stream puts the document at pass * source_size + offset; passes reach up to the target.
    goal = F.floor(F.col("target")).cast("long")
    begin = F.col("pass") * F.col("source_size") + F.col("offset")
    pieces = (
        streams.where("size > 0 and target >= 1")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")) - 1)))
        .withColumn("begin", begin)
        .withColumn("end", F.least(begin + F.col("size"), goal))
        .where("begin < end")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
        .withColumn("got", F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block))
    )
    slots = -(-facts["total"] // block)
    timed = pieces.join(schedule(goals.select("src", "target"), slots), ["src", "rank"], "left")
    taken = timed.groupBy("row").agg(
        F.sum("got").cast("long").alias("taken"), F.min(F.coalesce("slot", F.lit(slots))).alias("first_slot")
    )
    return streams.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )
