"""Files of a source tree as rows, and facts that regular expressions read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators import graph

# Folders that hold no sources, and the largest file that is read as text.
IGNORED = ("node_modules", ".next", "dist", "build", "coverage", ".git")
MAX_TEXT = 512_000
#: Kinds of package dependencies, the strongest first.
KINDS = {"dependencies": "runtime", "devDependencies": "development", "optionalDependencies": "optional", "peerDependencies": "peer"}


# Files of a project that are no sources but tell of it.
PROJECT_FILES = (r"(^|/)Dockerfile[^/]*$", r"(^|/)docker-compose[^/]*$", r"(^|/)tsconfig\.json$", r"(^|/)package\.json$", r"(^|/)next\.config\.(js|mjs|cjs|ts)$")
SOURCE_FILES = (r"\.(ts|tsx|js|jsx|mjs|cjs)$",)
DECLARATIONS = r"\.d\.ts$"


def walk(spark: SparkSession, root: str, include: Sequence[str] = SOURCE_FILES, ignored_paths: Sequence[str] = (), exclude: str | None = DECLARATIONS) -> DataFrame:
    """path (relative), length, text (null for large files) of the files below root whose path matches include, but exclude.

    Ignored folders are left out at any depth, ignored_paths (relative to root) with all that is in them. Names that begin
    with a dot or an underscore are hidden from Spark's readers; such files (.env) need a copy under another name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.element_at(F.split("path", base + "/", 2), -1), "^/+", "")
    ignored = "(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/"
    wanted = F.col("path").rlike("|".join(f"(?:{p})" for p in include)) & ~F.col("path").rlike(ignored)
    wanted = wanted & ~F.col("path").rlike(exclude) if exclude else wanted
    for p in ignored_paths:
        wanted = wanted & ~F.startswith("path", F.lit(p.rstrip("/") + "/"))
    rows = files.select(path.alias("path"), "length", "content").where(wanted)
    return rows.withColumn("text", F.when(F.col("length") <= MAX_TEXT, F.decode("content", "UTF-8"))).drop("content")


def read_json(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON documents, one a file or one a line, as rows of schema; what is no JSON is a row of nulls, or with strict left out."""
    mode = "DROPMALFORMED" if strict else "PERMISSIVE"
    return spark.read.schema(schema).option("mode", mode).option("multiLine", "true").json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, url, main_branch, aliases of the repositories that a registry file lists, the first of a name."""
    repository = "name string, url string, mainBranch string, queryAliases map<string,array<string>>"
    listed = read_json(spark, path, f"repositories array<struct<{repository.replace(' ', ':').replace(',:', ',')}>>")
    rows = listed.select(F.posexplode("repositories").alias("at", "r")).where("r.name is not null")
    first = rows.groupBy("r.name").agg(F.min_by("r", "at").alias("b"))
    return first.select("name", F.col("b.url").alias("url"), F.coalesce("b.mainBranch", F.lit("main")).alias("main_branch"), F.col("b.queryAliases").alias("aliases"))


def commits_above(commits: DataFrame, tip: str) -> DataFrame:
    """sha of a commit and all its ancestors, from commits (sha, parents array<string>)."""
    edges = commits.select(F.col("sha").alias("src"), F.explode("parents").alias("dst"))
    return graph.closure(edges, commits.where(F.col("sha") == tip).select(F.col("sha").alias("node"))).select(F.col("node").alias("sha"))


def package_dependencies(manifests: DataFrame) -> DataFrame:
    """repository, name, version, kind from manifests (repository, text of package.json); a name's strongest kind counts."""
    rows = None
    for rank, (field, kind) in enumerate(KINDS.items()):
        entries = F.map_entries(F.from_json(F.get_json_object("text", f"$.{field}"), "map<string,string>"))
        one = manifests.select("repository", F.explode(entries).alias("e")).select("repository", "e.key", "e.value", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("repository", F.col("key").alias("name")).agg(F.min(F.struct("rank", "kind", "value")).alias("b"))
    return best.select("repository", "name", F.col("b.value").alias("version"), F.col("b.kind").alias("kind"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """status A, M, D or R (with previous_path) between two listings (path, hash); equal content under another name is a rename."""
    both = before.select("path", F.col("hash").alias("b")).join(after.select("path", F.col("hash").alias("a")), "path", "full")
    gone, new = both.where("a is null").select(F.col("path").alias("previous_path"), F.col("b").alias("hash")), both.where("b is null").select("path", F.col("a").alias("hash"))
    pair = lambda df, c: df.groupBy("hash").agg(F.min(c).alias(c))
    renamed = pair(gone, "previous_path").join(pair(new, "path"), "hash").select("path", "previous_path", F.lit("R").alias("status"))
    none = F.lit(None).cast("string").alias("previous_path")
    added = new.join(renamed, "path", "left_anti").select("path", none, F.lit("A").alias("status"))
    removed = gone.join(renamed, "previous_path", "left_anti").select(F.col("previous_path").alias("path"), none, F.lit("D").alias("status"))
    modified = both.where("a <> b").select("path", none, F.lit("M").alias("status"))
    return renamed.unionByName(added).unionByName(removed).unionByName(modified)


def env_keys(text: Column) -> Column:
    """Keys that an env file sets."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="), F.lit(1)))


def imports(text: Column) -> Column:
    """Specifiers that a module imports, re-exports or requires."""
    pattern = r"""(?:from\s+|import\s+|import\(\s*|require\(\s*)["']([^"']+)["']"""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def exports(text: Column) -> Column:
    """Names that a module exports by declaration."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), F.lit(1)))
