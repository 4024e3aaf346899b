"""Code of repositories: parts stand for files, line items for their imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import modules, renames
from lodestrata.plans import query
from lodestrata.sources.tables import Tables

#: A part's file, and an import's specifier (of the part `q`), as SQL that Spark and DuckDB read alike.
_FILE = "concat('src/d', {0} % 17, '/f', {0}, CASE {0} % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' WHEN 3 THEN '.js' ELSE '.d.ts' END)"
_SPECIFIER = """CASE l_linenumber % 7 WHEN 0 THEN concat('../d', q % 17, '/f', q) WHEN 1 THEN concat('@/d', q % 17, '/f', q) WHEN 2 THEN concat('@/d', q % 17, '/f', q, '.js')
  WHEN 3 THEN concat('@lib/f', q) WHEN 4 THEN CASE WHEN q % 2 = 0 THEN 'react' ELSE 'entry' END WHEN 5 THEN concat('@/deep/f', q) ELSE concat('./../d', q % 17, '/./f', q) END"""
_PATHS = (("@/*", "src/*"), ("@/deep/*", "src/d5/*"), ("@lib/*", "src/d3/*"), ("entry", "src/d1/f1.tsx"), ("@/*", "src2/*"))
_LINKS = f"""SELECT p_partkey, {_FILE.format("p_partkey")} AS file, concat('r', p_partkey % 4) AS repository, CASE WHEN p_partkey % 11 IN (5, 6, 7, 9) THEN '*' ELSE concat('n', p_partkey % 3) END AS name,
  CASE WHEN p_partkey % 11 = 7 THEN p_partkey + 4 WHEN p_partkey % 11 = 9 THEN p_partkey WHEN p_partkey % 11 = 6 THEN p_partkey - 8 ELSE p_partkey - 4 END AS q, concat('n', (p_partkey + 1) % 3) AS imported
  FROM {{part}} WHERE p_partkey % 11 BETWEEN 1 AND 9"""

_NORMAL = """list_reduce([''] || string_split({0}, '/'), lambda acc, part: CASE WHEN acc IS NULL OR part IN ('', '.') THEN acc
  WHEN part = '..' THEN CASE WHEN acc = '' THEN NULL WHEN contains(acc, '/') THEN regexp_replace(acc, '/[^/]*$', '') ELSE '' END WHEN acc = '' THEN part ELSE acc || '/' || part END)"""
_RESOLVED = f"""f AS (SELECT concat('r', p_partkey % 4) AS repository, {_FILE.format("p_partkey")} AS file FROM part),
  im AS (SELECT DISTINCT concat('r', l_partkey % 4) AS repository, {_FILE.format("l_partkey")} AS file, {_SPECIFIER} AS specifier FROM (SELECT *, l_partkey + 4 * l_linenumber AS q FROM lineitem)),
  pa(pattern, target) AS (VALUES {", ".join(map(str, _PATHS))}),
  al AS (SELECT repository, file, specifier, arg_max(CASE WHEN contains(pattern, '*') THEN replace(target, '*', '') || substr(specifier, length(pattern)) ELSE target END,
      (NOT contains(pattern, '*'), length(pattern), -ascii(target[4]))) AS path
    FROM im JOIN pa ON specifier = pattern OR contains(pattern, '*') AND starts_with(specifier, replace(pattern, '*', '')) WHERE NOT starts_with(specifier, '.') GROUP BY ALL),
  pt AS (SELECT repository, file, specifier, {_NORMAL.format("regexp_replace(file, '/[^/]*$', '') || '/' || specifier")} AS path FROM im WHERE starts_with(specifier, '.')
    UNION ALL SELECT repository, file, specifier, {_NORMAL.format("path")} FROM al),
  ca AS (SELECT repository, file, specifier, unnest(range(15)) AS rank, unnest([CASE WHEN regexp_matches(path, '\\.[cm]?jsx?$') THEN regexp_replace(path, '\\.[cm]?jsx?$', '.ts') END,
      CASE WHEN regexp_matches(path, '\\.[cm]?jsx?$') THEN regexp_replace(path, '\\.[cm]?jsx?$', '.tsx') END, CASE WHEN regexp_matches(path, '\\.[cm]?[jt]sx?$') THEN path END]
      || list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], lambda e: path || e) || list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'], lambda e: path || '/index' || e)) AS module FROM pt),
  fi AS (SELECT c.repository, c.file, specifier, arg_min(module, rank) AS module FROM ca c JOIN f ON f.repository = c.repository AND f.file = module AND NOT ends_with(module, '.d.ts') GROUP BY ALL),
  resolved AS (SELECT repository, file, specifier, module FROM im LEFT JOIN fi USING (repository, file, specifier))"""


def _tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, files and path aliases."""
    spark = t.part.sparkSession
    files = t.part.select(F.expr("concat('r', p_partkey % 4)").alias("repository"), F.expr(_FILE.format("p_partkey")).alias("file"))
    named = t.lineitem.select("l_partkey", "l_linenumber", F.expr("l_partkey + 4 * l_linenumber").alias("q"))
    imports = named.select(F.expr("concat('r', l_partkey % 4)").alias("repository"), F.expr(_FILE.format("l_partkey")).alias("file"), F.expr(_SPECIFIER).alias("specifier"))
    paths = spark.createDataFrame([(f"r{i}", *p) for i in range(4) for p in _PATHS], "repository string, pattern string, target string")
    return imports, files, paths


@query(f"WITH {_RESOLVED} SELECT repository, file, specifier, module FROM resolved")
def module_resolution(t: Tables) -> DataFrame:
    return modules.resolve(*_tables(t))


def _name(module: str) -> Column:
    return F.concat(F.lit("n"), F.length(module) % 3)


@query(f"""WITH RECURSIVE {_RESOLVED}, ex AS (SELECT concat('r', p_partkey % 4) AS repository, {_FILE.format("p_partkey")} AS file, unnest(['n0', 'n1']) AS name FROM part WHERE p_partkey % 11 = 0),
  li AS (SELECT repository, file, name, {_FILE.format("q")} AS target, imported FROM ({_LINKS.format(part="part")})),
  k AS (SELECT DISTINCT repository, module, 'n' || length(module) % 3 AS name FROM resolved WHERE module IS NOT NULL),
  walk(repository, module, name, "at", "as", hop, named) AS (SELECT repository, module, name, module, name, 0, true FROM k UNION
    SELECT w.repository, w.module, w.name, target, CASE WHEN li.name = '*' THEN w."as" ELSE imported END, hop + 1, named AND li.name <> '*'
    FROM walk w JOIN li ON li.repository = w.repository AND li.file = w."at" AND (li.name = w."as" OR li.name = '*' AND NOT EXISTS (SELECT 1 FROM li x WHERE x.repository = w.repository AND x.file = w."at" AND x.name = w."as"))
    WHERE hop < 6),
  found AS (SELECT w.repository, w.module, w.name, min((hop, "at", "as")) AS f FROM walk w JOIN ex ON ex.repository = w.repository AND ex.file = "at" AND ex.name = "as" GROUP BY 1, 2, 3),
  last AS (SELECT repository, module, name, arg_max(("at", "as", hop), hop) AS l FROM walk WHERE named GROUP BY 1, 2, 3)
  SELECT repository, module, name, coalesce(f[2], l[1]) AS declared_in, coalesce(f[3], l[2]) AS declared_name, CAST(coalesce(f[1], l[3]) AS INTEGER) AS hops FROM last LEFT JOIN found USING (repository, module, name)""")
def reexport_follow(t: Tables) -> DataFrame:
    names = modules.imported(*_tables(t)).select("repository", "module", _name("module").alias("name"))
    repository, file = F.expr("concat('r', p_partkey % 4)").alias("repository"), F.expr(_FILE.format("p_partkey")).alias("file")
    exports = t.part.where("p_partkey % 11 = 0").select(repository, file, F.explode(F.array(F.lit("n0"), F.lit("n1"))).alias("name"))
    links = t.part.sparkSession.sql(_LINKS.format(part="{part}"), part=t.part)
    return modules.follow(names, exports, links.select("repository", "file", "name", F.expr(_FILE.format("q")).alias("target"), "imported"))


@query()
def file_changes(t: Tables) -> DataFrame:
    """Orders as files, their items as lines: kept, added to, moved, moved with a line less, moved with every other line changed."""
    kind, number = F.col("l_orderkey") % 5, F.col("l_linenumber")
    line = lambda *more: F.concat_ws(" ", number, "l_partkey", "l_suppkey", *more)
    text = lambda lines, path: lines.groupBy(path.alias("path")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    path = lambda folder: F.concat(folder, F.col("l_orderkey"))
    before = text(t.lineitem.withColumn("line", line()), path(F.lit("src/")))
    kept = t.lineitem.where((kind != 2) | (number != 1))
    changed = F.when((kind == 4) & (number % 2 == 0), line(F.lit("changed"))).otherwise(line())
    more = kept.withColumn("line", changed).select("l_orderkey", "line")
    more = more.unionByName(t.lineitem.where((kind == 1) & (number == 1)).select("l_orderkey", F.lit("9 one more").alias("line")))
    return renames.changes(before, text(more, path(F.when(kind < 2, "src/").otherwise("lib/"))))
