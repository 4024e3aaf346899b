"""Upkeep of an index: registry, decisions, closed facts, kinds of questions. Customers stand for repositories, orders for decisions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.operators import history, sync
from lodestrata.plans import query
from lodestrata.sources.tables import Tables


@query("""WITH r AS (SELECT o_custkey AS name, CASE WHEN o_custkey % 3 = 0 THEN 's1' ELSE 's2' END AS head FROM orders GROUP BY 1),
  k AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 5 > 0 THEN 's1' END AS last_sha, c_nationkey % 4 = 0 AS retired FROM customer WHERE c_custkey % 11 > 0)
  SELECT CAST(coalesce(r.name, k.name) AS VARCHAR) AS repository, last_sha, CASE WHEN r.name IS NULL THEN 'retired' WHEN last_sha IS NULL THEN 'indexed' WHEN retired THEN 'restored' WHEN head = last_sha THEN 'unchanged' ELSE 'synced' END AS action
  FROM r FULL JOIN k ON r.name = k.name WHERE r.name IS NOT NULL OR NOT retired""")
def registry_reconcile(t: Tables) -> DataFrame:
    head = F.when(F.col("o_custkey") % 3 == 0, "s1").otherwise("s2")
    registry = t.orders.select(F.col("o_custkey").cast("string").alias("name"), head.alias("head"))
    last = F.when(F.col("c_custkey") % 5 > 0, "s1")
    known = t.customer.where("c_custkey % 11 > 0").select(F.col("c_custkey").cast("string").alias("name"), last.alias("last_sha"), (F.col("c_nationkey") % 4 == 0).alias("retired"))
    return sync.reconcile_registry(registry, known)


_DECISIONS = """d AS (SELECT o_orderkey AS id, 'k' || o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'k' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'k' || (o_custkey + 1) END AS names FROM orders)"""


@query(f"""WITH {_DECISIONS}, l AS (SELECT a.id, a.status, max(b.id) AS old FROM d a JOIN d b ON b.key = a.names AND b.id < a.id AND b.status IN ('accepted', 'proposed') GROUP BY ALL)
  SELECT d.id, d.key, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.old = d.id AND l.status = 'accepted') THEN 'superseded' ELSE d.status END AS status, l.old AS supersedes_id FROM d LEFT JOIN l ON l.id = d.id""")
def supersede_by_name(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected")
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    names = F.when(F.col("o_orderkey") % 3 == 0, key(F.col("o_custkey"))).when(F.col("o_orderkey") % 3 == 1, key(F.col("o_custkey") + 1))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), key(F.col("o_custkey")).alias("key"), status.alias("status"), names.alias("names"))
    return history.supersede_named(rows, "key", "names", "id").select("id", "key", "status", "supersedes_id")


@query("""WITH f AS (SELECT o_orderkey AS id, 'f' || o_custkey AS file, o_orderstatus <> 'F' AS active FROM orders), w AS (SELECT DISTINCT 'f' || c_custkey AS file FROM customer WHERE c_acctbal < 0),
  s AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1)
  SELECT id, file, active AND NOT (file IN (SELECT file FROM w) AND id NOT IN (SELECT id FROM s)) AS active,
    CASE WHEN active AND file IN (SELECT file FROM w) AND id NOT IN (SELECT id FROM s) THEN 's9' END AS removed_sha FROM f""")
def deactivate_by_file(t: Tables) -> DataFrame:
    file = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    facts = t.orders.select(F.col("o_orderkey").alias("id"), file("o_custkey").alias("file"), none.alias("hash"), (F.col("o_orderstatus") != "F").alias("active"), none.alias("created_sha"), none.alias("removed_sha"))
    kept = t.lineitem.where("l_returnflag = 'N' and l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    closed = sync.deactivate(facts, t.customer.where("c_acctbal < 0").select(file("c_custkey").alias("file")), "file", "s9", kept)
    return closed.select("id", "file", "active", "removed_sha")


#: Sayings that questions are made of: what the text of a conversation asks for follows from its number of letters.
_SAID = ("", " why did we choose this", " which repos use it", " project testing strategy", " data of the endpoint", " neden tercih ettik", " adr", " veri nereden alır", " repo bağımlı", " hata yönetimi repo")
_ALL = "says(d0) OR says(d1) OR says(t0) AND says(t1) AS decision, says(s0) AND says(s1) AS strategy, says(l0) OR says(l1) AS links, says(f0) OR says(f1) AS flow"


def _says(sql: str) -> str:
    named = {"d": rules.DECISION, "t": rules.DECISION_TOGETHER, "s": rules.STRATEGY_TOGETHER, "l": rules.LINKS, "f": rules.FLOW}
    for letter, patterns in named.items():
        for i, p in enumerate(patterns):
            sql = sql.replace(f"says({letter}{i})", f"regexp_matches(q, '(?i){p}')")
    return sql


@query(f"SELECT conv_id, turn, {_says(_ALL)} FROM (SELECT conv_id, turn, text || {list(_SAID)!r}[length(text) % {len(_SAID)} + 1] AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL)")
def question_subjects(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.length("text") % len(_SAID) + 1).cast("int"))
    asked = t.conversations.where("role = 'user' and text is not null").select("conv_id", "turn", rules.question_subjects(F.concat("text", said)).alias("s"))
    return asked.select("conv_id", "turn", "s.*")
