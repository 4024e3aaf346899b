"""Module resolution over tables of files, imports, exports and path aliases: which module a specifier means, and which declares a name.

A relative specifier is taken from the importing file's folder; another one by the longest path alias of the repository that it
begins with (`@/*` stands for a folder, one without a star for the whole specifier); what is neither leaves the repository. The
path that results has ranked candidates: for a script's name its typed twin and itself, then the path with each ending, then the
folder's index. The first candidate that is a file of the repository is the module. Each file names the paths that have it among
their candidates, so a specifier is an equi-join on (repository, prefix) and a path one on (repository, path); a path that many
imports lead to is looked up once, and no specifier is compared with all files or aliases. What grows with files, imports or names is
exchanged, not broadcast: files of a table of paths are so much smaller than its rows that Spark would take it for a small one.

An imported name is followed through re-exports: a module that declares the name ends the way; one that re-exports it by name leads
to the module and the name there; else stars lead on with the same name (`default` passes no star). The frontier of all names
moves a hop at a time, HOPS at most, and never comes back to a module and name that it met for an import, so cycles end. Of the
modules that declare a name the one with the fewest hops counts, then the smaller path; if none is known to declare it, the
module where re-exports by name end.

Defined results: rows with a null repository, file or specifier are left out; repeated rows count once; a specifier without a file
has a null module; paths above the root leave the repository; declaration files are no modules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.storage import small, stored

# Endings of source files in the order in which they are tried, and hops through re-exports.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
HOPS = 6
#: Rows of some names up to which a side is broadcast, some 10 MB; beyond, the join shuffles.
BROADCAST_NAMES = 50_000
# Endings of scripts that may mean a typed twin; names that are source files themselves; specifiers that start from their file's folder.
SCRIPTS = (".js", ".jsx", ".mjs", ".mjsx", ".cjs", ".cjsx")
ITSELF = r"(?<!\.d)\.[cm]?[jt]sx?\z"
RELATIVE = r"^\.{1,2}(/|$)"


def _side(df: DataFrame) -> DataFrame:
    """df as a side of a join by equality: broadcast if it is counted to be small, else exchanged, whatever Spark thinks of its size."""
    counted = small(df, BROADCAST_NAMES)
    return df.hint("merge") if counted is df else counted


def normal_path(c: Column) -> Column:
    """A path without `.` and `..` steps; null if it leads above the root."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(acc.isNull(), acc).when((part == "") | (part == "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def candidates(path: Column) -> list[Column]:
    """Files that a path may mean, best first; null where it means none by that rank."""
    twin = [F.when(path.rlike(r"\.[cm]?jsx?\z"), F.concat(F.regexp_replace(path, r"\.[cm]?jsx?\z", ""), F.lit(e))) for e in ENDINGS[:2]]
    itself = F.when(path.rlike(ITSELF), path)
    folder = F.when(path == "", F.lit("index")).otherwise(F.concat(path, F.lit("/index")))
    return [*twin, itself, *[F.concat(p, F.lit(e)) for p in (path, folder) for e in ENDINGS]]


def meant_by(file: Column) -> Column:
    """The reverse of candidates: path and rank of all paths that have a file among theirs."""
    as_path = lambda when, path, rank: F.when(when, F.struct(path.alias("path"), F.lit(rank).alias("rank")))
    without = lambda ending: F.substring(file, F.lit(1), F.length(file) - len(ending))
    out = [as_path(file.endswith(e), F.concat(without(e), F.lit(script)), rank) for rank, e in enumerate(ENDINGS[:2]) for script in SCRIPTS]
    out.append(as_path(file.rlike(ITSELF), file, 2))
    out += [as_path(file.endswith(e), without(e), 3 + i) for i, e in enumerate(ENDINGS)]
    for i, e in enumerate(ENDINGS):
        index = F.when(file == f"index{e}", F.lit("")).otherwise(without(f"/index{e}"))
        out.append(as_path((file == f"index{e}") | file.endswith(f"/index{e}") & (index != ""), index, 9 + i))
    return F.array_compact(F.array(*out))


def _asked(imports: DataFrame) -> DataFrame:
    """Adds `origin` to imports: the folder that a relative specifier starts from, else nothing."""
    folder = F.regexp_replace("file", "(^|/)[^/]*$", "")
    rows = imports.select("repository", "file", "specifier").dropna()
    return rows.withColumn("origin", F.when(F.col("specifier").rlike(RELATIVE), folder).otherwise(F.lit("")))


def _paths(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """repository, origin, specifier, path of the different ones asked for, those that stay in their repository."""
    rows = asked.select("repository", "origin", "specifier").distinct()
    relative = F.col("specifier").rlike(RELATIVE)
    aliases = paths.select("repository", "pattern", "target").dropna().distinct()
    star = F.endswith("pattern", F.lit("*"))
    prefix = F.when(star, F.regexp_replace("pattern", r"\*$", "")).otherwise(F.col("pattern"))
    aliases = aliases.select("repository", prefix.alias("prefix"), star.alias("open"), F.regexp_replace("target", r"\*$", "").alias("to"))
    aliases = stored(aliases.groupBy("repository", "prefix", "open").agg(F.min("to").alias("to")), "aliases")
    beside = rows.where(relative).withColumn("path", normal_path(F.concat("origin", F.lit("/"), "specifier")))
    lengths = aliases.groupBy(F.length("prefix").alias("length")).agg(F.lit(1).alias("one"))  # one row a length of prefixes
    others = rows.where(~relative).join(small(lengths.select("length")), F.length("specifier") >= F.col("length"))
    others = others.withColumn("prefix", F.substring("specifier", F.lit(1), F.col("length")))
    met = others.join(_side(aliases), ["repository", "prefix"]).where(F.col("open") | (F.col("specifier") == F.col("prefix")))
    best = met.groupBy("repository", "origin", "specifier").agg(F.max(F.struct((~F.col("open")).alias("whole"), "length", "to")).alias("a"))
    rest = F.when(F.col("a.whole"), F.lit("")).otherwise(F.substring("specifier", F.col("a.length") + 1, F.length("specifier")))
    aliased = best.withColumn("path", normal_path(F.concat(F.col("a.to"), rest))).drop("a")
    return beside.unionByName(aliased).where("path is not null")


def _modules(paths: DataFrame, files: DataFrame) -> DataFrame:
    """repository, path, module of the different paths (repository, path) that mean a file of theirs."""
    known = files.select("repository", "file").dropna().where(r"file not rlike '\\.d\\.[cm]?ts$'").distinct()
    meant = known.select("repository", F.inline(meant_by(F.col("file"))))
    found = paths.select("repository", "path").distinct().join(meant.hint("merge"), ["repository", "path"])
    first = found.groupBy("repository", "path").agg(F.min("rank").alias("rank"))  # which tells the file
    return first.select("repository", "path", F.element_at(F.array(*candidates(F.col("path"))), F.col("rank") + 1).alias("module"))


def resolve(imports: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """repository, file, specifier, module of the different imports (repository, file, specifier).

    files: repository, file; paths: repository, pattern (`@/*`), target (`src/*`).
    """
    asked = _asked(imports).distinct()
    led = stored(_paths(asked, paths), "paths")
    meant = led.join(_modules(led, files).hint("merge"), ["repository", "path"]).select("repository", "origin", "specifier", "module")
    return asked.join(meant.hint("merge"), ["repository", "origin", "specifier"], "left").select("repository", "file", "specifier", "module")


def imported(imports: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """repository, module: the different modules that resolve gives, without the imports being told apart."""
    return _modules(_paths(_asked(imports), paths), files).select("repository", "module").distinct()


def follow(names: DataFrame, exports: DataFrame, reexports: DataFrame, hops: int = HOPS) -> DataFrame:
    """repository, module, name, declared_in, declared_name, hops of the different imported names (repository, module, name).

    exports: repository, file, name (declared there); reexports: repository, file, name (`*` for all), target (a module), imported.
    """
    start = names.select("repository", "module", "name").dropna().distinct()
    own = _side(stored(exports.select("repository", F.col("file").alias("at"), F.col("name").alias("as")).dropna().distinct(), "exports"))
    links = reexports.select("repository", F.col("file").alias("at"), F.col("name").alias("as"), "target", "imported").where("target is not null").distinct()
    links = stored(links, "reexports")
    named, stars = _side(links.where("`as` <> '*'")), _side(links.where("`as` = '*'").select("repository", "at", "target"))
    renamed = _side(links.where("`as` <> '*'").select("repository", "at", "as").distinct())
    key = ["repository", "module", "name"]
    here = start.select(*key, F.col("module").alias("at"), F.col("name").alias("as"), F.lit(0).alias("hop"), F.struct(F.lit(0).alias("hop"), F.col("module").alias("at"), F.col("name").alias("as")).alias("end"))
    here = stored(here, "names")
    seen, out, ends = here.select(*key, "at", "as"), None, here.select(*key, "end")
    for hop in range(hops + 1):
        done = here.join(own, ["repository", "at", "as"]).select(*key, F.struct("hop", "at", "as").alias("found"))
        done = stored(done.groupBy(*key).agg(F.min("found").alias("found")), "declared")
        out = done if out is None else out.unionByName(done)
        if hop == hops:
            break
        left = here.join(_side(done.select(*key)), key, "left_anti")
        moved = F.lit(hop + 1)
        by_name = left.join(named, ["repository", "at", "as"]).select(*key, F.col("target").alias("at"), F.col("imported").alias("as"), F.col("end.hop").alias("was"), "end")
        by_name = by_name.withColumn("end", F.when(F.col("was") == hop, F.struct(moved.alias("hop"), "at", "as")).otherwise(F.col("end"))).drop("was")
        open_ = left.join(renamed, ["repository", "at", "as"], "left_anti").where("`as` <> 'default'")
        by_star = open_.join(stars, ["repository", "at"]).select(*key, F.col("target").alias("at"), "as", "end")
        step = by_name.unionByName(by_star).groupBy(*key, "at", "as").agg(F.max("end").alias("end"))
        here = stored(step.join(_side(seen), [*key, "at", "as"], "left_anti").withColumn("hop", moved), "hop")
        if here.isEmpty():
            break
        seen, ends = seen.unionByName(here.select(*key, "at", "as")), ends.unionByName(here.select(*key, "end"))
    found = out.groupBy(*key).agg(F.min("found").alias("found"))
    # Where no declaration is known: the last module on the way by names, of equally far ones the smaller.
    last = ends.groupBy(*key).agg(F.min(F.struct((-F.col("end.hop")).alias("neg"), F.col("end.at").alias("at"), F.col("end.as").alias("as"))).alias("last"))
    both = last.join(found.hint("merge"), key, "left")
    return both.select(
        *key,
        F.coalesce("found.at", "last.at").alias("declared_in"),
        F.coalesce("found.as", "last.as").alias("declared_name"),
        F.coalesce(F.col("found.hop"), -F.col("last.neg")).alias("hops"),
    )
