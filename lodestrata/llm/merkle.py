r"""Merkle manifest of a dataset: a hash tree for each group of rows, a tree over the groups' roots, and every row's proof.

H is the lowercase hex SHA-256 of its inputs, one after another, digests as hex text. A leaf is H of the row's values, each as
its number of UTF-8 bytes, `:` and the value, or `-` for null. Leaves of a group ascend by their id (repeated rows by their
hash); while more than one node remains, each run of `arity` consecutive nodes becomes its H, the last run also with fewer nodes,
even with one. What remains is the group's root; the groups' roots, ordered by group (null first), make the root likewise.

The tree is built by windows. Leaves are dealt to blocks of consecutive leaves, each as wide as a tree of several levels. In a
block every level's node stands on the row of its first leaf, so that lag and lead columns with the level's fixed
offsets, masked by a node's slot in its run and by the run's length, are its siblings; rows of first children hash the parents.
What a node has beside it is carried on to the leaves below it by the last such value at or before each leaf. Blocks' nodes are
the leaves of the next round: of 10^10 rows there are four rounds.

Scale. Texts are hashed in the scan's partitions and never exchanged. Leaves are numbered by ranges of (group, id), with offsets from
the partitions' counts, so that no task holds a group, however large; each window holds one block. Proofs come down by
joins of blocks with their leaves, at most one block's leaves to a key; nothing is broadcast.

Defined results: a null group is a group; a null id sorts first and is not tampered; null values are `-`, an empty text is `0:`;
repeated rows are leaves of their own; texts of any length are hashed whole; an empty table gives no rows; columns that are not
asked for are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored

#: Leaves of a block, at most.
BLOCK = 1024
STEPS = "array<struct<before:string,after:string>>"


def leaf(*values: Column) -> Column:
    """H of values as a leaf has them."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings on the way up give."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """All siblings on the way up, left to right, level by level, one after another."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `at`, each row's place from 0 in its group, and `n`, the group's rows."""
    # The partition number is read by two queries, so it is written once: a second range exchange may cut elsewhere.
    parts = stored(rows.repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "leaves")
    sizes = parts.groupBy("group", "part").agg(F.count("*").alias("size"))
    of_group = Window.partitionBy("group")  # one row a partition
    sizes = sizes.select(
        F.col("group").alias("of"),
        F.col("part").alias("in"),
        F.coalesce(F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(of_group).alias("n"),
    )
    own = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order)) - 1
    both = parts.withColumn("own", own).join(sizes, (F.col("part") == F.col("in")) & F.col("group").eqNullSafe(F.col("of")))
    return both.withColumn("at", F.col("before") + F.col("own")).drop("part", "own", "of", "in", "before")


def _climb(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """Adds `steps`, what stands beside the way up through `levels` levels at most, and `up`, on a block's first row its node."""
    block = Window.partitionBy("group", F.expr(f"at div {arity**levels}")).orderBy("at")
    out, beside = rows.withColumn("up", F.col("hash")), []
    for level in range(levels):
        step = arity**level
        node, more = F.col("at") % step == 0, F.col("n") > step  # a node's first row; whether nodes of this level have parents
        slot = F.expr(f"at div {step} % {arity}")
        left = [F.when(slot >= s, F.lag("up", s * step).over(block)) for s in range(arity - 1, 0, -1)]
        right = [F.when(slot < arity - s, F.lead("up", s * step).over(block)) for s in range(1, arity)]  # null beyond the last run's end
        out = out.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))
        out = out.withColumn(f"beside{level}", F.when(node & more, F.struct(F.col("left").alias("before"), F.col("right").alias("after"))))
        parent = F.when(F.col("at") % (step * arity) == 0, F.when(more, F.sha2(F.concat("up", "right"), 256)).otherwise(F.col("up")))
        out = out.withColumn("up", parent).drop("left", "right")
        beside.append(f"beside{level}")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    found = F.array(*[F.last(b, ignorenulls=True).over(upto) for b in beside]).cast(STEPS)
    return out.withColumn("steps", F.filter(found, lambda s: s.isNotNull())).drop(*beside)


def _tree(rows: DataFrame, arity: int) -> tuple[list[DataFrame], int]:
    """The rounds of the groups' trees over rows (group, at, n, hash, others), lowest first, and the leaves of a block."""
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    size, rounds = arity**levels, []
    left = rows.agg(F.max("n")).first()[0] or 0  # one number
    while True:
        need = next(j for j in range(levels + 1) if arity**j >= left or j == levels)
        rounds.append(stored(_climb(rows, arity, need), "merkle"))
        if left <= size:
            return rounds, size
        left = -(-left // size)
        above = F.expr(f"(n + {size - 1}) div {size}")
        rows = rounds[-1].where(F.col("at") % size == 0).select("group", F.expr(f"at div {size}").alias("at"), above.alias("n"), F.col("up").alias("hash"))


def _on(low: DataFrame, high: DataFrame, place: Column) -> DataFrame:
    """low with the steps of its block's node in high (group, at, steps, others) after its own, and high's other columns."""
    high = high.withColumnsRenamed({"group": "of", "at": "place", "steps": "more"})
    both = low.join(high, F.col("group").eqNullSafe(F.col("of")) & (place == F.col("place")))
    return both.withColumn("steps", F.concat("steps", "more")).drop("of", "place", "more")


def manifest(rows: DataFrame, arity: int = 2) -> DataFrame:
    """Columns of rows (group, id, leaf, others), subroot, root and steps (siblings before and after, from the leaf upwards).

    group is a string; rows of others must not be called hash, at, n, up, steps, subroot or root.
    """
    low, size = _tree(_placed(rows.withColumn("hash", F.col("leaf")), "id", "leaf"), arity)
    subroots = low[-1].where("at = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("up").alias("hash"))
    high, _ = _tree(_placed(subroots, "name"), arity)
    top = high[-1].where("at = 0").select("group", F.lit(0).alias("at"), F.array().cast(STEPS).alias("steps"), F.col("up").alias("root"))
    for i, round_ in enumerate(reversed(high)):
        place = F.lit(0) if i == 0 else F.expr(f"at div {size}")
        top = _on(round_.select("group", "at", "steps", *(("name", F.col("hash").alias("subroot")) if i == len(high) - 1 else ())), top, place)
    way = top.select(F.col("name").alias("group"), F.lit(0).alias("at"), "steps", "subroot", "root")
    for i, round_ in enumerate(reversed(low)):
        keep = [F.col(c) for c in rows.columns if c != "group"] if i == len(low) - 1 else []
        way = _on(round_.select("group", "at", "steps", *keep), way, F.lit(0) if i == 0 else F.expr(f"at div {size}"))
    return way.drop("at")


def verify(manifest: DataFrame, seen: Column) -> DataFrame:
    """manifest with folded_root, the root that the leaf `seen` leads to, and verified, whether it is the root."""
    return manifest.withColumn("folded_root", folded(seen, F.col("steps"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, arity: int = 2, every: int = 7, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """group (lang), id, leaf, subroot, root, steps, folded_root, verified for every row of docs.

    Where `every` divides the crc32 of the decimal id, the row is checked with 1 added to n_chars.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = leaf(*[more if c == "n_chars" else F.col(c) for c in columns])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    rows = docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(*map(F.col, columns)).alias("leaf"), F.when(picked, changed).alias("changed")
    )
    return verify(manifest(rows, arity), F.coalesce("changed", "leaf")).drop("changed")
