"""Versions of repositories: nations stand for repositories, customers for their routes and facts, orders for edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import snapshots
from lodestrata.plans import query
from lodestrata.sources.storage import shared_dir
from lodestrata.sources.tables import Tables

# Every third nation changes in the second version: a route in five goes, one in four renders otherwise, edges and facts alike.
_BASE = """routes AS (SELECT concat('r', c_nationkey) AS repository, concat('/c/', c_custkey) AS route, concat('f', c_custkey % 7) AS source_file, c_mktsegment AS rendering, c_custkey AS k, c_nationkey AS n FROM customer),
  graph AS (SELECT concat('r', c_nationkey) AS repository, concat('c', o_custkey) AS src, concat('t', o_orderkey % 50) AS dst,
    CASE o_orderkey % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'reads' WHEN 2 THEN 'fetches' ELSE 'tests' END AS type, o_orderkey AS k, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
  facts AS (SELECT concat('r', c_nationkey) AS repository, CASE WHEN c_custkey % 2 = 0 THEN 'cache' ELSE 'build' END AS type, concat('s', c_custkey) AS subject, CAST(floor(c_acctbal) AS BIGINT) AS content, c_custkey AS k, c_nationkey AS n FROM customer)"""
_LATER = {
    "routes": "SELECT repository, route, source_file, CASE WHEN k % 4 = 1 THEN 'other' ELSE rendering END AS rendering FROM routes WHERE n % 3 = 0 AND k % 5 <> 0 UNION ALL SELECT repository, concat(route, '/new'), source_file, rendering FROM routes WHERE n % 3 = 0 AND k % 9 = 0",
    "graph": "SELECT repository, src, CASE WHEN k % 11 = 0 THEN concat(dst, 'x') ELSE dst END AS dst, type FROM graph WHERE n % 3 = 0 AND k % 7 <> 0",
    "facts": "SELECT repository, type, subject, CASE WHEN k % 6 = 0 THEN content + 1 ELSE content END AS content FROM facts WHERE n % 3 = 0 AND k % 10 <> 3",
}
_COLUMNS = {"routes": "repository, route, source_file, rendering", "graph": "repository, src, dst, type", "facts": "repository, type, subject, content"}


def _two_versions(t: Tables) -> str:
    """The path of a table of two versions: all repositories, then those that changed."""
    spark, path = t.customer.sparkSession, shared_dir(t.customer.sparkSession, "versions")
    base = _BASE.replace("FROM customer)", "FROM {customer})").replace("FROM orders JOIN customer ON", "FROM {orders} JOIN {customer} ON")
    sql = lambda text: spark.sql(f"WITH {base} {text}", customer=t.customer, orders=t.orders)
    every = [f"r{r['n']}" for r in t.nation.select(F.col("n_nationkey").alias("n")).collect()]
    snapshots.commit(spark, path, "s1", every, {name: sql(f"SELECT {c} FROM {name}") for name, c in _COLUMNS.items()})
    snapshots.commit(spark, path, "s2", [r for r in every if int(r[1:]) % 3 == 0], {name: sql(text) for name, text in _LATER.items()}, after=1)
    return path


_STATES = f"WITH {_BASE}, " + ", ".join(f"{name}2 AS ({text})" for name, text in _LATER.items()) + ", " + ", ".join(f"{name}1 AS (SELECT {c} FROM {name} WHERE n % 3 = 0)" for name, c in _COLUMNS.items())
_DIFF = """SELECT '{0}' AS section, repository, {1} AS name, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT {2}, min({3}) AS v FROM {0}1 GROUP BY ALL) b FULL JOIN (SELECT {2}, min({3}) AS v FROM {0}2 GROUP BY ALL) a USING ({2}) WHERE a.v IS DISTINCT FROM b.v"""
_FLOWS = "(SELECT repository, concat_ws(' ', type, src, dst) AS name FROM graph{} WHERE type <> 'tests')"
_TARGET = "(SELECT DISTINCT type, repository, dst, src FROM graph{} WHERE type IN ('reads', 'fetches'))"


@query(f"""{_STATES} {_DIFF.format("routes", "concat_ws(' ', route, source_file)", "repository, route, source_file", "rendering")}
  UNION ALL {_DIFF.format("facts", "concat_ws(' ', type, subject)", "repository, type, subject", "content")}
  UNION ALL SELECT 'flows', repository, name, 'added' FROM ({_FLOWS.format(2)} EXCEPT {_FLOWS.format(1)})
  UNION ALL SELECT 'flows', repository, name, 'removed' FROM ({_FLOWS.format(1)} EXCEPT {_FLOWS.format(2)})
  UNION ALL SELECT DISTINCT CASE type WHEN 'reads' THEN 'config' ELSE 'api' END, repository, dst, 'changed'
    FROM (({_TARGET.format(1)} EXCEPT {_TARGET.format(2)}) UNION ALL ({_TARGET.format(2)} EXCEPT {_TARGET.format(1)}))""")
def behaviour_diff(t: Tables) -> DataFrame:
    path = _two_versions(t)
    return snapshots.behaviour_diff(t.customer.sparkSession, path, 1, 2)


@query(f"""WITH {_BASE} SELECT repository, 'routes' AS relation, count(*) AS n, sum(k) AS total FROM (SELECT repository, CAST(replace(route, '/c/', '') AS BIGINT) AS k FROM routes) GROUP BY 1
  UNION ALL SELECT repository, 'graph', count(*), sum(CAST(replace(src, 'c', '') AS BIGINT)) FROM graph GROUP BY 1
  UNION ALL SELECT repository, 'facts', count(*), sum(content) FROM facts GROUP BY 1""")
def point_in_time(t: Tables) -> DataFrame:
    """What the first version says, read after the second one."""
    path, spark = _two_versions(t), t.customer.sparkSession
    first = snapshots.version_of(spark, path, "s1")
    number = {"routes": F.regexp_replace("route", "/c/", ""), "graph": F.regexp_replace("src", "c", ""), "facts": F.col("content")}
    rows = None
    for name, value in number.items():
        one = snapshots.read(spark, path, name, first).groupBy("repository").agg(F.count("*").alias("n"), F.sum(value.cast("long")).alias("total"))
        one = one.select("repository", F.lit(name).alias("relation"), "n", "total")
        rows = one if rows is None else rows.unionByName(one)
    return rows
