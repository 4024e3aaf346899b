"""Relations of repositories as versions: a commit writes what changed, any version can be read, two versions can be compared.

Each relation is kept in folders, one for each repository and commit that changed it. A version (see sources.versions) names
for every relation the folder of each repository, and the commit that it shows, so a commit writes the changed repositories'
rows only and names the other folders again; readers of older versions go on; of two commits that begin from one version one
fails. A comparison reads only the repositories whose folders differ.

Scale. A version's file has about a hundred bytes for each repository and relation; rows are never brought to the driver. A
repository's rows may fill any number of files.

Defined results: rows with a null repository are left out; a changed repository without rows has none in that version; repeated rows
are kept; a relation that no version names is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators import history
from lodestrata.sources import versions

# Edges that are flows, and those whose targets are compared as configuration and interfaces.
FLOWS = ("calls", "renders", "reads", "fetches", "submits-to", "references", "delegates-to")
TARGETS = {"reads": "config", "fetches": "api"}


def _folder(repository: str) -> str:
    return hashlib.sha256(repository.encode()).hexdigest()[:32]


def commit(spark: SparkSession, path: str, sha: str, repositories: Sequence[str], relations: dict[str, DataFrame], after: int | None = None) -> int:
    """Makes the next version: the rows of the given repositories (those that changed) are now those of relations.

    Every relation has a column repository; rows of other repositories are not read. after: the version that the caller began
    from, else the newest. Raises versions.Conflict if another commit followed it first.
    """
    newest, said = versions.newest(spark, path)
    if after is not None and after != newest:
        raise versions.Conflict(f"{path} has gone on from version {after} to {newest}")
    known = {name: dict(r["folders"]) for name, r in said.get("relations", {}).items()}
    schemas = {name: r["schema"] for name, r in said.get("relations", {}).items()}
    changed = spark.createDataFrame([(r, _folder(r)) for r in set(repositories)], "repository string, part string")
    for name, df in relations.items():
        folder = f"{path}/{name}/{newest + 1}-{uuid.uuid4().hex[:12]}"
        rows = df.join(F.broadcast(changed), "repository").select(*df.columns, "part")  # as many rows as the caller named
        rows.write.partitionBy("part").parquet(folder)
        schemas[name] = df.schema.json()
        kept = spark.read.schema(rows.schema).parquet(folder).select("part").distinct()
        written = {r["part"] for r in kept.collect()}  # of the changed repositories
        folders = known.setdefault(name, {})
        for repository in repositories:
            folders.pop(repository, None)
            if _folder(repository) in written:
                folders[repository] = f"{folder}/part={_folder(repository)}"
    said = {"sha": sha, "relations": {name: {"schema": schemas[name], "folders": folders} for name, folders in known.items()}}
    return versions.commit(spark, path, newest, said)


def version_of(spark: SparkSession, path: str, sha: str) -> int | None:
    """The newest version that shows commit sha."""
    for number in reversed(versions.numbers(spark, path)):
        said = versions.content(spark, path, number)
        if said is not None and said["sha"] == sha:
            return number
    return None


def _relation(spark: SparkSession, path: str, name: str, version: int | None) -> dict:
    said = versions.newest(spark, path)[1] if version is None else versions.content(spark, path, version)
    if said is None or name not in said.get("relations", {}):
        raise KeyError(f"no relation {name} in version {version} of {path}")
    return said["relations"][name]


def _rows(spark: SparkSession, relation: dict, folders: Sequence[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(relation["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, name: str, version: int | None = None, repositories: Sequence[str] | None = None) -> DataFrame:
    """A relation in a version, else the newest; of some repositories only, whose folders alone are read."""
    relation = _relation(spark, path, name, version)
    wanted = relation["folders"] if repositories is None else {r: f for r, f in relation["folders"].items() if r in set(repositories)}
    return _rows(spark, relation, sorted(wanted.values()))


def changed(spark: SparkSession, path: str, name: str, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """A relation before and after, of the repositories whose folders differ."""
    old, new = (_relation(spark, path, name, v) for v in (before, after))
    some = {r for r in old["folders"].keys() | new["folders"].keys() if old["folders"].get(r) != new["folders"].get(r)}
    return tuple(_rows(spark, x, sorted(f for r, f in x["folders"].items() if r in some)) for x in (old, new))


def diff(spark: SparkSession, path: str, name: str, key: Sequence[str], attributes: Sequence[str], before: int, after: int) -> DataFrame:
    """repository, key, change (added, removed, changed) of a relation with one row a key; a key's smallest row counts."""
    every = ["repository", *key]
    one = lambda df: df.groupBy(*every).agg(F.min(F.struct(*attributes)).alias("r")).select(*every, "r.*")
    old, new = changed(spark, path, name, before, after)
    return history.diff(one(old), one(new), every, attributes)


def behaviour_diff(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """section, repository, name, change between two versions of the relations routes, graph and facts.

    routes: repository, route, source_file and attributes; graph: repository, src, dst, type; facts: repository, type, subject,
    content. Sections: routes (added, removed, changed), flows (edges added or removed), config and api (targets that are read or
    fetched from other places than before), facts.
    """
    routes = columns(spark, path, "routes", after)
    attributes = [c for c in routes if c not in ("repository", "route", "source_file")]
    out = [diff(spark, path, "routes", ["route", "source_file"], attributes, before, after).select(F.lit("routes").alias("section"), "repository", F.concat_ws(" ", "route", "source_file").alias("name"), "change")]
    old, new = (df.where(F.col("type").isin(*FLOWS)).select("repository", "src", "dst", "type").distinct() for df in changed(spark, path, "graph", before, after))
    edge = F.concat_ws(" ", "type", "src", "dst").alias("name")
    for a, b, change in ((new, old, "added"), (old, new, "removed")):
        out.append(a.join(b, ["repository", "src", "dst", "type"], "left_anti").select(F.lit("flows").alias("section"), "repository", edge, F.lit(change).alias("change")))
    section = F.element_at(F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair]), F.col("type"))
    sides = [df.where(F.col("type").isin(*TARGETS)).withColumn("section", section).select("section", "repository", F.col("dst").alias("name"), "src") for df in (old, new)]
    # A target has changed if a source came or went; equal sets of sources leave nothing.
    moved = sides[0].subtract(sides[1]).unionByName(sides[1].subtract(sides[0])).select("section", "repository", "name").distinct()
    out.append(moved.withColumn("change", F.lit("changed")))
    out.append(diff(spark, path, "facts", ["type", "subject"], ["content"], before, after).select(F.lit("facts").alias("section"), "repository", F.concat_ws(" ", "type", "subject").alias("name"), "change"))
    return reduce(DataFrame.unionByName, out)


def columns(spark: SparkSession, path: str, name: str, version: int | None = None) -> list[str]:
    """The columns of a relation in a version."""
    return StructType.fromJson(json.loads(_relation(spark, path, name, version)["schema"])).names
