"""Structured Streaming over event streams: rollups by event time, deduplication, sessions, incremental application.

Each transformation takes and returns a DataFrame and gives the same rows on a bounded one, so batch and stream share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrata.functions.text import normal_remote
from lodestrata.operators import sync
from lodestrata.sources import versions
from lodestrata.sources.storage import small


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with `ts` as a timestamp and rows later than `delay` dropped where state is kept."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """start, event_type, n, total per window."""
    rolled = timed(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rolled.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "1 day") -> DataFrame:
    rolled = timed(events, delay).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return rolled.select(F.col("w.start").alias("start"), "n")


def debounced(events: DataFrame, key: str, gap: str, delay: str = "1 day") -> DataFrame:
    """One row for each burst of a key: events closer than gap are one session."""
    sessions = timed(events, delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("w.start").alias("started"), "n")


def once(events: DataFrame, *key: str, delay: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark: a job that is already on its way is joined, not repeated."""
    return timed(events, delay).dropDuplicatesWithinWatermark(list(key))


def running_miss_rate(events: DataFrame) -> DataFrame:
    """user_id, n, misses so far; in update mode the users of each micro-batch."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("misses"))


#: What is read of a push: the fields of the usual hosts, and those of plain senders.
PUSH = (
    "seq long, ref string, commit string, after string, checkout_sha string, object_kind string, repository_name string, "
    "head_commit struct<id:string>, pusher struct<name:string>, "
    "repository struct<git_ssh_url:string,git_http_url:string,url:string,ssh_url:string,clone_url:string,html_url:string>, "
    "project struct<git_ssh_url:string,git_http_url:string,web_url:string>"
)


def pushes(payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """seq, repository, sha, source, status of push payloads (body, JSON text), as a batch or a stream.

    status: ok, malformed, no-commit (none of 40 hexadecimal digits), deletion (all zeros), unknown (of no repository in the
    registry: name, url, main_branch), ignored (another branch). A repository is known by its name, else by a clone address
    in any of its forms; of several addresses the first known one counts, of entries of one address the smallest name. Both are
    equi-joins with the registry, which is broadcast if it is counted to be small.
    """
    p = payloads.select(F.from_json("body", PUSH).alias("p"), F.get_json_object("body", "$.repository").alias("given"))
    sha = F.coalesce("p.commit", "p.after", "p.checkout_sha", "p.head_commit.id")
    fields = [f"p.repository.{x}" for x in ("git_ssh_url", "git_http_url", "url", "ssh_url", "clone_url", "html_url")] + [f"p.project.{x}" for x in ("git_ssh_url", "git_http_url", "web_url")]
    remotes = F.array_distinct(F.array_compact(F.array(*[normal_remote(F.col(f)) for f in fields])))
    source = F.when((F.col("p.object_kind") == "push") | F.col("p.project").isNotNull(), "gitlab").when(F.col("p.head_commit").isNotNull() | F.col("p.pusher").isNotNull(), "github").otherwise("generic")
    rows = p.select(
        F.col("p.seq").alias("seq"),
        F.lower(sha).alias("sha"),
        F.regexp_replace("p.ref", "^refs/heads/", "").alias("branch"),
        source.alias("source"),
        F.coalesce("p.repository_name", F.when(~F.startswith("given", F.lit("{")), F.col("given"))).alias("named"),
        remotes.alias("remotes"),
        F.coalesce(F.to_json("p"), F.lit("{}")).alias("read"),
    )
    entry = F.struct(F.col("name").alias("repository"), "main_branch")
    names = small(registry.groupBy(F.col("name").alias("known")).agg(F.min(entry).alias("by_name")))
    places = small(registry.groupBy(normal_remote(F.col("url")).alias("known")).agg(F.min(entry).alias("found")))
    rows = rows.join(names, F.col("named") == F.col("known"), "left").drop("known")
    # A push has few address fields: each is looked up by a join of its own, so a stream keeps no state.
    for i in range(len(fields)):
        rows = rows.join(places, F.get("remotes", F.lit(i)) == F.col("known"), "left").drop("known").withColumnRenamed("found", f"by_remote{i}")
    rows = rows.withColumn("hit", F.coalesce("by_name", *[f"by_remote{i}" for i in range(len(fields))]))
    full = F.coalesce(F.col("sha").rlike("^[0-9a-f]{40}$"), F.lit(False))
    status = (
        F.when(F.col("read") == "{}", "malformed")
        .when(~full, "no-commit")
        .when(F.col("sha").rlike("^0{40}$"), "deletion")
        .when(F.col("hit").isNull(), "unknown")
        .when(F.col("branch").isNotNull() & (F.col("branch") != F.col("hit.main_branch")), "ignored")
        .otherwise("ok")
    )
    return rows.select("seq", F.col("hit.repository").alias("repository"), "sha", "source", status.alias("status"))


def apply_commits(commits: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Applies commit events (repository, seq, sha) to a Parquet table of the newest commit per repository.

    Each batch reads the newest complete version of the table, whoever wrote it, and commits the next one; if another commit came
    first it begins anew. A commit with an older seq than the stored one changes nothing, and neither does one that was applied
    before, so a batch may run again and a stream may start with a new checkpoint.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("repository").agg(F.max(F.struct("seq", "sha")).alias("c")).select("repository", "c.*")
        while True:
            after, _ = versions.newest(spark, table)
            both = new.unionByName(sync.read(spark, table, "commits", after)) if after else new
            newest = both.groupBy("repository").agg(F.max(F.struct("seq", "sha")).alias("c")).select("repository", "c.*")
            try:
                sync.commit(table, after, commits=newest)
                return
            except versions.Conflict:
                continue

    return commits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
