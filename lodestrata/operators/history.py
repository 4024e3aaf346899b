"""History operators: slowly changing rows, snapshot diffs, change logs, immutable snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.relational import as_of


def reconcile(old: DataFrame, seen: DataFrame, key: Sequence[str], sha: str) -> DataFrame:
    """Mark and sweep: rows seen now are active, rows not seen any more are closed at sha; created_sha stays.

    old: key, created_sha, removed_sha, active, and attributes; seen: key and attributes.
    Reconciling twice with the same rows changes nothing.
    """
    attributes = [c for c in seen.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in [*attributes, "created_sha", "removed_sha", "active"]])
    both = o.join(seen.withColumn("is_seen", F.lit(True)), list(key), "full")
    here = F.coalesce("is_seen", F.lit(False))
    return both.select(
        *key,
        *[F.when(here, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in attributes],
        F.coalesce("old_created_sha", F.lit(sha)).alias("created_sha"),
        F.when(here, F.lit(None)).when(F.col("old_active"), F.lit(sha)).otherwise(F.col("old_removed_sha")).alias("removed_sha"),
        here.alias("active"),
    )


def diff(before: DataFrame, after: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """key, change: added, removed or changed (null-safe) between two states with one row a key."""
    side = lambda df, x: df.select(*key, F.struct(*attributes).alias(x))
    both = side(before, "b").join(side(after, "a"), list(key), "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def content_hash(*columns: str) -> object:
    """A hash over columns that tells null from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def snapshot(df: DataFrame, key: Sequence[str], *columns: str) -> DataFrame:
    """One row a key with its rows as a sorted array of structs: an image that can be stored once and compared."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def append_snapshot(df: DataFrame, path: str, sha: str) -> bool:
    """Writes df under sha unless that snapshot exists: snapshots never change. Returns whether it was written."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sha={sha}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sha={sha}/_SUCCESS")):
        return False
    df.write.mode("overwrite").parquet(f"{path}/sha={sha}")
    return True


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keyed merge: a new row's non-null values win, other columns and rows stay."""
    attributes = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in attributes if c in new.columns])
    merged = [F.coalesce(f"new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in attributes]
    return old.join(n, list(key), "full").select(*key, *merged)


def supersede(decisions: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of each key's accepted rows the newest stays accepted, older ones become superseded; other states stay."""
    accepted = decisions.where("status = 'accepted'").groupBy(*key).agg(F.max(order).alias("_newest"))
    late = (F.col("status") == "accepted") & (F.col(order) < F.col("_newest"))
    return decisions.join(accepted, list(key), "left").withColumn("status", F.when(late, "superseded").otherwise(F.col("status"))).drop("_newest")


def supersede_named(decisions: DataFrame, key: str, names: str, id: str) -> DataFrame:
    """decisions with supersedes_id: the newest accepted or proposed earlier row of the key that a row names; it becomes superseded if the row is accepted.

    A row that names a key without such a row supersedes nothing.
    """
    older = decisions.where("status in ('accepted', 'proposed')").select(F.col(key).alias("_key"), F.col(id).alias("_at"), F.col(id).alias("_old"))
    naming = decisions.where(F.col(names).isNotNull()).select(F.col(id).alias("_id"), F.col(names).alias("_key"), (F.col(id) - 1).alias("_at"), (F.col("status") == "accepted").alias("_counts"))
    links = as_of(naming, older, "_key", "_at", "_old").where("as_of is not null").select("_id", "_counts", F.col("as_of").alias("supersedes_id"))
    hit = links.where("_counts").select(F.col("supersedes_id").alias("_gone")).distinct()
    out = decisions.join(links.select("_id", "supersedes_id"), F.col(id) == F.col("_id"), "left").join(hit, F.col(id) == F.col("_gone"), "left")
    return out.withColumn("status", F.when(F.col("_gone").isNotNull(), "superseded").otherwise(F.col("status"))).select(*decisions.columns, "supersedes_id")


def purge(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there: what a cascading delete leaves."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds columns that older rows lack and fills their nulls: an additive migration."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
