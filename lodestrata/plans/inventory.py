"""Inventory: filters, joins, latest rows, grouped reports, history. Orders and their parts stand for facts and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import history, relational
from lodestrata.plans import query
from lodestrata.sources.tables import Tables


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def scan_active_routes(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) AND value IS NOT NULL")
def filter_in_list(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct().orderBy("event_type").limit(2)
    return t.events.where("value is not null").join(kinds, "event_type", "left_semi").select("event_id", "event_type")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN 'listing' WHEN regexp_matches(url, '#') THEN 'anchor'
  WHEN regexp_matches(url, '/$') THEN 'index' ELSE 'detail' END AS kind, regexp_matches(url, '^https') AS secure FROM pages""")
def classify_case_chain(t: Tables) -> DataFrame:
    kind = F.when(F.col("url").rlike("[?&]page="), "listing").when(F.col("url").rlike("#"), "anchor").when(F.col("url").rlike("/$"), "index").otherwise("detail")
    return t.pages.select("page_id", kind.alias("kind"), F.col("url").rlike("^https").alias("secure"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_left_changes(t: Tables) -> DataFrame:
    pending = t.orders.where("o_orderstatus = 'P'")
    return t.customer.join(pending, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT o_orderpriority, s_name, p_brand, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL""")
def join_star_route_dependencies(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")
    joined = (
        lines.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.groupBy("o_orderpriority", "s_name", "p_brand").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""WITH e AS (SELECT l_partkey, l_linenumber, min(l_orderkey) AS x FROM lineitem GROUP BY ALL),
  a AS (SELECT l_partkey, min(l_orderkey) AS x FROM lineitem GROUP BY ALL)
  SELECT p_partkey, p_size % 7 AS line, coalesce(e.x, a.x) AS match FROM part
  LEFT JOIN e ON e.l_partkey = p_partkey AND e.l_linenumber = p_size % 7 LEFT JOIN a ON a.l_partkey = p_partkey""")
def join_exact_else_any(t: Tables) -> DataFrame:
    left = t.part.select("p_partkey", (F.col("p_size") % 7).alias("line"))
    right = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("line"), "l_orderkey")
    return relational.exact_else_any(left, right, ["p_partkey"], ["line"], "l_orderkey")


@query("""SELECT a.s_suppkey AS consumer, b.s_suppkey AS provider, CASE WHEN a.s_suppkey < b.s_suppkey THEN 'outgoing' ELSE 'incoming' END AS direction
  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def join_self_links(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_nationkey")
    both = relational.pairs_within(rows, "s_nationkey", "s_suppkey", "consumer", "provider").where("consumer <> provider")
    return both.select("consumer", "provider", F.when(F.col("consumer") < F.col("provider"), "outgoing").otherwise("incoming").alias("direction"))


@query("SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def semi_with_evidence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_without_evidence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def anti_orphan_vectors(t: Tables) -> DataFrame:
    active = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.select("vec_id", "label").join(active, "vec_id", "left_anti")


@query("""SELECT coalesce(c.c_custkey, o.o_custkey) AS key, CASE WHEN o.o_custkey IS NULL THEN 'unused' ELSE 'used' END AS state
  FROM customer c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c.c_custkey = o.o_custkey""")
def anti_registry_membership(t: Tables) -> DataFrame:
    used = t.orders.select(F.col("o_custkey").alias("key"), F.lit("used").alias("state")).distinct()
    return t.customer.select(F.col("c_custkey").alias("key")).join(used, "key", "full").select("key", F.coalesce("state", F.lit("unused")).alias("state"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 46)")
def anti_unvalidated_targets(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_returnflag = 'R' and l_quantity > 46").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_name").join(seen, "p_partkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 4")
def scalar_subquery_count(t: Tables) -> DataFrame:
    broad = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).count().where("count > 4")
    return t.orders.select("o_orderkey").join(broad, "o_orderkey", "left_semi")


@query("SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag)[1] AS first_flag, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1")
def first_symbol_min_by(t: Tables) -> DataFrame:
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_returnflag"))
    return t.lineitem.groupBy("l_orderkey").agg(first["l_returnflag"].alias("first_flag"), F.min("l_shipdate").alias("first_ship"))


@query("""WITH r AS (SELECT user_id, ts, event_id, value FROM events WHERE event_id % 3 = 0),
  q AS (SELECT event_id AS q_id, user_id AS q_user, ts AS q_ts FROM events WHERE event_id % 3 <> 0),
  j AS (SELECT q_id, event_id, row_number() OVER (PARTITION BY q_id ORDER BY ts DESC, event_id DESC) AS n
        FROM q LEFT JOIN r ON user_id = q_user AND ts <= q_ts)
  SELECT q_id AS event_id, event_id AS as_of FROM j WHERE n = 1""")
def asof_latest_run(t: Tables) -> DataFrame:
    # Every third event is a run; each other event gets the latest run of its user at or before it.
    events = t.events.select("event_id", "user_id", F.struct("ts", F.col("event_id")).alias("at"))
    runs = events.where("event_id % 3 = 0").select("user_id", "at", F.col("event_id").alias("run"))
    asked = t.events.where("event_id % 3 <> 0").select("event_id", "user_id", F.struct("ts", F.lit(2**62).alias("event_id")).alias("at"))
    return relational.as_of(asked, runs, "user_id", "at", "run").select("event_id", "as_of")


@query("""SELECT c_custkey, x.event_id AS latest_event FROM customer LEFT JOIN
  (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) x ON x.user_id = c_custkey""")
def latest_event_join(t: Tables) -> DataFrame:
    newest = relational.latest(t.events, ["user_id"], "event_id").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("latest_event"))
    return t.customer.select("c_custkey").join(newest, "c_custkey", "left")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_key(t: Tables) -> DataFrame:
    return relational.latest(t.events, ["user_id"], "event_id", "event_type")


@query("""WITH s AS (SELECT o_custkey % 50 AS h, o_orderkey AS stored_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n
    FROM orders WHERE year(o_orderdate) < 1996),
  f AS (SELECT o_custkey % 50 AS h, o_orderkey AS fresh_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n
    FROM orders WHERE year(o_orderdate) >= 1996)
  SELECT coalesce(s.h, f.h) AS h, stored_id, fresh_id FROM s FULL JOIN f ON s.h = f.h AND s.n = f.n""")
def multiset_hash_match(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("h", F.col("o_custkey") % 50)
    stored = rows.where(F.year("o_orderdate") < 1996).select("h", F.col("o_orderkey").alias("stored_id"))
    fresh = rows.where(F.year("o_orderdate") >= 1996).select("h", F.col("o_orderkey").alias("fresh_id"))
    return relational.multiset_match(stored, fresh, "h", "stored_id", "fresh_id")


@query("""SELECT count(*) AS n_docs, count(DISTINCT lang || chr(31) || source) AS n_subjects, count(*) FILTER (l.doc_id IS NOT NULL) AS with_evidence,
  count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
  CASE WHEN count(*) = 0 THEN 1 ELSE round(count(*) FILTER (l.doc_id IS NOT NULL) / count(*), 4) END AS coverage
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def quality_report(t: Tables) -> DataFrame:
    labels = t.labels.withColumn("labelled", F.lit(True))
    rows = t.documents.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    report = rows.agg(
        F.count("*").alias("n_docs"),
        F.countDistinct("lang", "source").alias("n_subjects"),
        F.count_if("labelled").alias("with_evidence"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
    )
    return report.withColumn("coverage", relational.ratio(F.col("with_evidence"), F.col("n_docs")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def agg_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, min(l_shipdate) AS first_ship, count(*) AS n_evidence, count(*) FILTER (l_returnflag = 'R') AS n_located
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def evidence_rollup(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship"), F.count("*").alias("n_evidence"), F.count_if(F.col("l_returnflag") == "R").alias("n_located")
    )
    return t.orders.select("o_orderkey").join(lines, "o_orderkey")


@query("""SELECT user_id % 20 AS question, event_type AS signal, count(*) AS reports, max(ts) AS last_reported, min(event_id) AS first_id
  FROM events GROUP BY ALL""")
def feedback_backlog(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 20).alias("question"), F.col("event_type").alias("signal"), "ts", "event_id")
    return rows.groupBy("question", "signal").agg(F.count("*").alias("reports"), F.max("ts").alias("last_reported"), F.min("event_id").alias("first_id"))


@query("""SELECT l_returnflag AS signal, l_linestatus AS state, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def feedback_summary_grouping_sets(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("signal"), F.col("l_linestatus").alias("state"))
    return rows.cube("signal", "state").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""SELECT 'event_type' AS dimension, event_type AS name, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY 2
  UNION ALL SELECT 'empty', CASE WHEN value < 10 THEN 'yes' ELSE 'no' END, count(*) FROM events GROUP BY 2""")
def telemetry_tally(t: Tables) -> DataFrame:
    empty = F.when(F.col("value") < 10, "yes").otherwise("no")
    rows = t.events.select("event_type", F.hour("ts").cast("string").alias("hour"), empty.alias("empty"))
    return rows.unpivot([], ["event_type", "hour", "empty"], "dimension", "name").groupBy("dimension", "name").agg(F.count("*").alias("n"))


@query("SELECT l_shipdate < TIMESTAMP '1996-01-01' AS early, l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY ALL")
def edge_type_counts(t: Tables) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    return t.lineitem.groupBy(early.alias("early"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT lang, source, n_chars > 4000 AS late, doc_id FROM documents),
  a AS (SELECT lang, source, list(doc_id ORDER BY late, doc_id)[1] AS anchor, list(doc_id ORDER BY doc_id) AS files, count(*) AS n_rows FROM g GROUP BY ALL)
  SELECT lang, source, CAST(anchor AS VARCHAR) AS anchor, len(files) - 1 AS n_others, n_rows FROM a""")
def canonicalize_group(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source", "n_chars", "doc_id", F.col("doc_id").cast("string").alias("file"))
    merged = relational.merge_groups(rows, ["lang", "source"], F.col("n_chars") > 4000, "file", "doc_id")
    return merged.select("lang", "source", "anchor", F.size("others").cast("long").alias("n_others"), "n_rows")


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n
    FROM events WHERE value IS NOT NULL)
  SELECT event_type, max(value) FILTER (k = least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)) AS p50,
    max(value) FILTER (k = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)) AS p95 FROM s GROUP BY 1""")
def latency_percentiles(t: Tables) -> DataFrame:
    return relational.nearest_rank_by(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""WITH s AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
  SELECT source, max(n_chars) FILTER (k = n // 2 + 1) AS median FROM s GROUP BY 1""")
def upper_median(t: Tables) -> DataFrame:
    return relational.nearest_rank_by(t.documents, ["source"], "n_chars", {"median": 0.5})


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM events) WHERE n <= 500")
def retention_keep_newest(t: Tables) -> DataFrame:
    return relational.keep_newest(t.events, "event_id", 500).select("event_id", "user_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_keep_first(t: Tables) -> DataFrame:
    return relational.first_per(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("""WITH w(size) AS (VALUES (1), (2), (4), (8), (16)), n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
  SELECT n_regionkey, n, max(size) FILTER (size <= n) AS current_wave, min(size) FILTER (size > n) AS next_wave FROM n CROSS JOIN w GROUP BY ALL""")
def wave_lookup(t: Tables) -> DataFrame:
    waves = F.array(*map(F.lit, (1, 2, 4, 8, 16)))
    sized = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    done, ahead = F.filter(waves, lambda w: w <= F.col("n")), F.filter(waves, lambda w: w > F.col("n"))
    return sized.select("n_regionkey", "n", F.array_max(done).alias("current_wave"), F.array_min(ahead).alias("next_wave"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_score(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9800")
def except_files(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9800").select(F.col("c_nationkey").alias("nation"))
    return t.supplier.select(F.col("s_nationkey").alias("nation")).subtract(rich)


@query("""SELECT o_custkey AS key, 'added' AS change FROM orders WHERE year(o_orderdate) > 1995 EXCEPT SELECT o_custkey, 'added' FROM orders WHERE year(o_orderdate) <= 1995
  UNION ALL (SELECT o_custkey, 'removed' FROM orders WHERE year(o_orderdate) <= 1995 EXCEPT SELECT o_custkey, 'removed' FROM orders WHERE year(o_orderdate) > 1995)""")
def except_added_removed(t: Tables) -> DataFrame:
    late = F.year("o_orderdate") > 1995
    of = lambda rows: t.orders.where(rows).select(F.col("o_custkey").alias("key")).distinct()
    before, after = of(~late), of(late)
    added = after.join(before, "key", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.join(after, "key", "left_anti").withColumn("change", F.lit("removed")))


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderdate) FILTER (year(o_orderdate) <= 1995) AS b, max(o_orderdate) AS a FROM orders GROUP BY 1)
  SELECT k AS o_custkey, a AS last_order, CASE WHEN b IS NULL THEN 'new' ELSE 'old' END AS created_sha, true AS active FROM o
  WHERE a >= TIMESTAMP '1996-01-01'
  UNION ALL SELECT k, b, 'old', false FROM o WHERE a < TIMESTAMP '1996-01-01'""")
def scd_reconcile(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderdate")
    early = orders.where(F.year("o_orderdate") <= 1995).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    old = early.select("o_custkey", "last_order", F.lit("old").alias("created_sha"), F.lit(None).cast("string").alias("removed_sha"), F.lit(True).alias("active"))
    seen = orders.where(F.year("o_orderdate") >= 1996).groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return history.reconcile(old, seen, ["o_custkey"], "new").drop("removed_sha")


_DIFF = """WITH b AS (SELECT {k}, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE year(o_orderdate) <= 1995 GROUP BY 1),
  a AS (SELECT {k}, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE year(o_orderdate) > 1995 GROUP BY 1)
  SELECT coalesce(b.{k}, a.{k}) AS {k}, CASE WHEN b.{k} IS NULL THEN 'added' WHEN a.{k} IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM b FULL JOIN a ON b.{k} = a.{k} WHERE b.n IS DISTINCT FROM a.n OR b.p IS DISTINCT FROM a.p"""


def _diff(t: Tables, key: str) -> DataFrame:
    late = F.year("o_orderdate") > 1995
    of = lambda rows: t.orders.where(rows).groupBy(key).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return history.diff(of(~late), of(late), [key], ["n", "p"])


@query(_DIFF.format(k="o_custkey"))
def snapshot_diff_routes(t: Tables) -> DataFrame:
    return _diff(t, "o_custkey")


@query(_DIFF.format(k="o_orderpriority"))
def snapshot_diff_targets(t: Tables) -> DataFrame:
    return _diff(t, "o_orderpriority")


@query("""WITH n AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 12 THEN 'LARGE' END AS segment, max(o_totalprice) AS bal FROM orders GROUP BY 1)
  SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, c_name, coalesce(segment, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal
  FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def upsert_merge(t: Tables) -> DataFrame:
    new = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.count("*") > 12, "LARGE").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal")
    )
    return history.upsert(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), new, ["c_custkey"])


@query("""WITH d AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'proposed' END AS status FROM orders),
  m AS (SELECT o_custkey, max(o_orderkey) AS newest FROM d WHERE status = 'accepted' GROUP BY 1)
  SELECT o_orderkey, CASE WHEN status = 'accepted' AND o_orderkey < newest THEN 'superseded' ELSE status END AS status FROM d LEFT JOIN m USING (o_custkey)""")
def supersede_decisions(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("proposed")
    return history.supersede(t.orders.select("o_orderkey", "o_custkey", status.alias("status")), ["o_custkey"], "o_orderkey").select("o_orderkey", "status")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source <> 'src0')")
def purge_children(t: Tables) -> DataFrame:
    kept = t.documents.where("source <> 'src0'").select(F.col("doc_id").alias("vec_id"))
    return history.purge(t.embeddings.select("vec_id", "label"), kept, "vec_id")


@query(_DIFF.format(k="o_orderstatus"))
def snapshot_diff_facts(t: Tables) -> DataFrame:
    return _diff(t, "o_orderstatus")


@query("""SELECT l_orderkey, bool_and(l_shipdate >= o_orderdate) AS valid, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def bool_and_validity(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.col("l_shipdate") >= F.col("o_orderdate")).alias("valid"), F.count("*").alias("n"))


@query("""SELECT c_mktsegment, CASE WHEN count(*) >= 300 OR sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) >= 120 THEN 'product-app' ELSE 'library' END AS family,
  count(*) AS n FROM customer GROUP BY 1""")
def family_classifier(t: Tables) -> DataFrame:
    broad = (F.count("*") >= 300) | (F.count_if(F.col("c_acctbal") > 5000) >= 120)
    return t.customer.groupBy("c_mktsegment").agg(F.when(broad, "product-app").otherwise("library").alias("family"), F.count("*").alias("n"))


@query("""SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_run, o_orderkey AS to_run FROM orders""")
def run_chain(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", F.lag("o_orderkey").over(order).alias("from_run"), F.col("o_orderkey").alias("to_run"))
