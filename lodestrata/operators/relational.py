"""Relational operators of the inventory: lookups, latest rows, matching by multiset, grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.storage import small, stored


def exact_else_any(left: DataFrame, right: DataFrame, key: Sequence[str], also: Sequence[str], value: str) -> DataFrame:
    """Adds `match`: right's smallest value with key and also equal, else its smallest value with key equal, else null."""
    exact = right.groupBy(*key, *also).agg(F.min(value).alias("exact"))
    anyone = right.groupBy(*key).agg(F.min(value).alias("anyone"))
    joined = left.join(exact, [*key, *also], "left").join(anyone, list(key), "left")
    return joined.withColumn("match", F.coalesce("exact", "anyone")).drop("exact", "anyone")


def latest(df: DataFrame, key: Sequence[str], order: str, *columns: str) -> DataFrame:
    """The columns of each key's row with the largest order value; partial maxima before the exchange."""
    picked = df.groupBy(*key).agg(F.max(F.struct(order, *columns)).alias("row"))
    return picked.select(*key, "row.*")


def keep_newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the largest order value (a top-n, not a sort of all rows)."""
    return df.orderBy(F.desc(order)).limit(n)


def first_per(df: DataFrame, key: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def best_per(df: DataFrame, key: Sequence[str], score: str, id: str) -> DataFrame:
    """key, id, score of each key's row with the largest score, of equal ones the smallest id; partial maxima before the exchange."""
    best = df.groupBy(*key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(id)).alias("neg"))).alias("b"))
    return best.select(*key, (-F.col("b.neg")).alias(id), F.col("b.s").alias(score))


def numbered(df: DataFrame, key: Sequence[str], *order: str | Column, few: bool = False) -> DataFrame:
    """Adds `at`, the place (from 1) of each row of a key in the given order of columns, without a key in one task.

    Rows are dealt by ranges of (key, order) and numbered in their partition; the partitions' counts add up to what
    lies before. With few keys the counts are broadcast, which are some rows a partition; else Spark may choose the rows for it,
    as sorted numbers are small files.
    """
    parts = stored(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sizes = small(sizes) if few else sizes
    same = F.col("_part") == F.col("_p")
    for k in key:
        same = same & parts[k].eqNullSafe(F.col(f"_{k}"))
    own = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))
    return parts.withColumn("_own", own).join(sizes, same).select(*df.columns, (F.col("_own") + F.col("_before")).alias("at"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds to each left row right's latest value at or before it: one sort of both sides by key and time, no pairs."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(before)).where("_side = 1").drop("_v", "_side")


def multiset_match(old: DataFrame, fresh: DataFrame, key: str, stored_id: str, fresh_id: str) -> DataFrame:
    """Pairs rows of equal key one to one, in id order: (key, stored_id, fresh_id), null where no partner is left."""
    number = lambda df, i: numbered(df.select(key, i), [key], i).withColumnRenamed("at", "_n")
    return number(old, stored_id).join(number(fresh, fresh_id), [key, "_n"], "full").drop("_n")


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place floor(n * share), counted from 0, of the sorted values, at most the last."""
    place = F.least(F.size(values), F.floor(F.size(values) * F.lit(share)) + 1).cast("int")
    return F.element_at(F.sort_array(values), place)


def nearest_rank_by(df: DataFrame, key: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key, exact, with neither a key's values in one array nor in one task."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(*key, value), key, value, few=True)
    sizes = ranked.groupBy(*key).agg(F.max("at").alias("_size"))
    places = [F.struct(F.lit(name).alias("name"), F.least(F.col("_size"), F.floor(F.col("_size") * F.lit(s)) + 1).alias("at")) for name, s in shares.items()]
    wanted = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.explode(F.array(*places)).alias("_w"))
    same = ranked["at"] == F.col("_w.at")
    for k in key:
        same = same & ranked[k].eqNullSafe(F.col(f"_{k}"))
    found = ranked.join(small(wanted), same)
    return found.groupBy(*key).agg(*[F.min(F.when(F.col("_w.name") == name, F.col(value))).alias(name) for name in shares])


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 1 for an empty whole."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.round(part / whole, digits))


#: Pairs that one task makes, about; and rows of a key that are held against one part of the key's rows.
TASK_PAIRS, PART_ROWS = 10_000_000, 1_000


def pairs_within(df: DataFrame, key: str, value: str, left: str, right: str) -> DataFrame:
    """key, left, right: all ordered pairs of values of rows with the same key, a value with itself too.

    There are as many pairs as the squares of the keys' rows add up to, so a key's rows are dealt to parts of about PART_ROWS on
    both sides; each pair of parts meets in one place, and the places are dealt to as many tasks as the pairs need. A task
    holds parts, not a key.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).alias("_value")).where("_key is not null")
    sizes = stored(rows.groupBy("_key").agg(F.count("*").alias("_size")), "sizes")
    n = int(sizes.agg(F.coalesce(F.sum(F.col("_size").cast("double") * F.col("_size")), F.lit(0.0))).first()[0] // TASK_PAIRS) + 1
    parts = (F.floor((F.col("_size") - 1) / PART_ROWS) + 1).alias("_parts")
    dealt = rows.join(small(sizes.select("_key", parts)), "_key").withColumn("_part", F.pmod(F.xxhash64("_value"), F.col("_parts")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    mine = dealt.select("_key", F.col("_value").alias(left), F.col("_part").alias("_a"), others.alias("_b"))
    theirs = dealt.select("_key", F.col("_value").alias(right), others.alias("_a"), F.col("_part").alias("_b"))
    place = ["_key", "_a", "_b"]
    met = mine.repartition(n, *place).join(theirs.repartition(n, *place).hint("shuffle_hash"), place)
    return met.select(F.col("_key").alias(key), left, right)


def merge_groups(df: DataFrame, key: Sequence[str], anchor_last: Column, file: str, order: str) -> DataFrame:
    """One row a key: the anchor file (first by order, files flagged anchor_last after all others) and the other files."""
    first = F.min(F.struct(anchor_last.cast("int").alias("late"), F.col(order).alias("o"), F.col(file).alias("f")))
    merged = df.groupBy(*key).agg(first.alias("a"), F.sort_array(F.collect_set(file)).alias("files"), F.count("*").alias("n_rows"))
    return merged.select(*key, F.col("a.f").alias("anchor"), F.array_except("files", F.array(F.col("a.f"))).alias("others"), "n_rows")


def smallest_span(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, width: int) -> DataFrame:
    """Adds to each point the name of the smallest span [start, end] of its key that holds it.

    Spans are dealt to bins of `width`, so the interval join is an equi-join on (key, bin) with a check.
    """
    bins = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    s = bins.select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_name"))
    inside = (F.col(key) == F.col("_k")) & (F.col("_bin") == F.col("_b")) & (F.col(at) >= F.col("_s")) & (F.col(at) <= F.col("_e"))
    found = p.join(s, inside, "left")
    best = F.min(F.when(F.col("_s").isNotNull(), F.struct((F.col("_e") - F.col("_s")).alias("len"), F.col("_name").alias("name"))))
    return found.groupBy(*points.columns).agg(best.alias("_best")).select(*points.columns, F.col("_best.name").alias("holder"))
