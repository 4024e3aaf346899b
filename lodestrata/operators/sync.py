"""Incremental synchronisation of a fact table: reuse, create, deactivate, with an audit of each row, all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.relational import numbered
from lodestrata.sources import versions
from lodestrata.sources.storage import stored


def partition(facts: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """id, file, hash, action: what a sync does with the facts of changed files (file) and what was read of them anew.

    facts: id, file, hash, active; fresh: file, hash. An active fact of a changed file whose hash is read again is kept
    (reuse), one to one where a hash occurs more than once, the smallest id first; other active facts of these files are
    closed (deactivate); what is read beyond is new (create, id null). Facts of other files aren't touched. A file that was
    deleted is one that nothing is read of.
    """
    old = facts.where("active").select("id", "file", "hash").join(files.select("file").distinct(), "file", "left_semi")
    old = numbered(old, ["file", "hash"], "id")
    new = fresh.select("file", "hash", F.monotonically_increasing_id().alias("row"))
    new = numbered(new, ["file", "hash"], "row").select("file", "hash", "at", F.lit(True).alias("read"))
    both = old.join(new, ["file", "hash", "at"], "full")
    action = F.when(F.col("id").isNull(), "create").when(F.col("read"), "reuse").otherwise("deactivate")
    return both.select("id", "file", "hash", action.alias("action"))


def apply(facts: DataFrame, done: DataFrame, sha: str) -> DataFrame:
    """The facts after a sync to commit sha, by partition's rows: id, file, hash, active, created_sha, removed_sha.

    New facts get the ids that follow the largest one, in order of file and hash.
    """
    done = stored(done, "actions")
    most = facts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))  # one row
    new = numbered(done.where("action = 'create'").select("file", "hash"), [], "file", "hash").join(F.broadcast(most))
    created = new.select((F.col("most") + F.col("at")).alias("id"), "file", "hash", F.lit(True).alias("active"), F.lit(sha).alias("created_sha"), F.lit(None).cast("string").alias("removed_sha"))
    gone = done.where("action = 'deactivate'").select("id", F.lit(True).alias("gone"))
    closed = F.coalesce("gone", F.lit(False))
    kept = facts.join(gone, "id", "left").select(
        "id", "file", "hash", (F.col("active") & ~closed).alias("active"), "created_sha", F.when(closed, F.lit(sha)).otherwise(F.col("removed_sha")).alias("removed_sha")
    )
    return kept.unionByName(created)


def audit(done: DataFrame, sha: str) -> DataFrame:
    """sha, id, action, file, old_hash, new_hash of each fact that a sync concerned."""
    old, new = F.when(F.col("action") != "create", F.col("hash")), F.when(F.col("action") != "deactivate", F.col("hash"))
    return done.select(F.lit(sha).alias("sha"), "id", "action", "file", old.alias("old_hash"), new.alias("new_hash"))


def missing_vectors(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active facts without a vector: new ones, and kept ones whose vector is not there."""
    return facts.where("active").join(vectors.select("id").distinct(), "id", "left_anti")


def orphan_vectors(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose fact is gone or closed."""
    return vectors.join(facts.where("active").select("id"), "id", "left_anti")


def deactivate(facts: DataFrame, which: DataFrame, on: str, sha: str, but: DataFrame | None = None) -> DataFrame:
    """facts with the active ones closed at sha whose `on` (id, file or subject) is in which, but those with an id in `but`."""
    hit = which.select(on).distinct().withColumn("_hit", F.lit(True))
    rows = facts.join(hit, on, "left")
    if but is not None:
        rows = rows.join(but.select("id").distinct().withColumn("_but", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("_but", F.lit(None).cast("boolean"))
    closes = F.col("active") & F.coalesce("_hit", F.lit(False)) & ~F.coalesce("_but", F.lit(False))
    return rows.withColumns({"removed_sha": F.when(closes, F.lit(sha)).otherwise(F.col("removed_sha")), "active": F.col("active") & ~closes}).select(*facts.columns)


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new's keys replaced by those of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version of a table of versions, None if there is none."""
    return versions.newest(spark, path)[0] or None


def commit(path: str, after: int | None = None, **tables: DataFrame) -> int:
    """Writes tables as the version of path that follows `after`, else the newest one: all of them or, to readers, none.

    They lie in a folder of this attempt; of two commits that begin from one version one raises versions.Conflict.
    """
    spark = next(iter(tables.values())).sparkSession
    number = versions.newest(spark, path)[0] if after is None else after
    folder = f"{path}/v={number + 1}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return versions.commit(spark, path, number, {"folder": folder})


def read(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A table of a version, else of the newest complete one."""
    said = versions.newest(spark, path)[1] if number is None else versions.content(spark, path, number)
    return spark.read.parquet(f"{said['folder']}/{name}")


def sync(spark: SparkSession, path: str, fresh: DataFrame, files: DataFrame, sha: str) -> int:
    """One sync of the table at path (`facts`, `audit`) to commit sha: what was read of changed files becomes its facts."""
    after = version(spark, path)
    facts = read(spark, path, "facts", after)
    done = stored(partition(facts, fresh, files), "partition")
    return commit(path, after, facts=apply(facts, done, sha), audit=read(spark, path, "audit", after).unionByName(audit(done, sha)))


def reconcile_registry(registry: DataFrame, known: DataFrame, check_commits: bool = True, retire_missing: bool = True) -> DataFrame:
    """repository, action, last_sha: what a pass over the registry (name, head) does with the known repositories (name, last_sha, retired).

    What was never indexed is indexed, what was retired comes back, others are synced, or unchanged if their head is the commit
    that was indexed last; known ones that are not in the registry any more are retired. Without check_commits others are left alone,
    without retire_missing missing ones. Rows without a name are left out; of rows of one name the smallest counts.
    """
    one = lambda df, *columns: df.where("name is not null").groupBy("name").agg(F.min(F.struct(*columns)).alias("r")).select("name", "r.*")
    both = one(registry, "head").withColumn("listed", F.lit(True)).join(one(known, "last_sha", "retired").withColumn("is_known", F.lit(True)), "name", "full")
    listed, retired = F.coalesce("listed", F.lit(False)), F.coalesce("retired", F.lit(False))
    action = (
        F.when(listed & F.col("last_sha").isNull(), "indexed")
        .when(listed & retired, "restored")
        .when(listed & F.lit(check_commits), F.when(F.col("head").eqNullSafe(F.col("last_sha")), "unchanged").otherwise("synced"))
        .when(~listed & ~retired & F.lit(retire_missing), "retired")
    )
    return both.select(F.col("name").alias("repository"), action.alias("action"), "last_sha").where("action is not null")
