"""Operations: telemetry, service levels, gates, audits, windows in time. Events stand for answered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.operators import audit, health, sync
from lodestrata.plans import query
from lodestrata.sources.tables import Tables


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


_LAG = "CAST(greatest(0, epoch_us(min(l_shipdate)) - epoch_us(o_orderdate)) // 1000000 AS BIGINT)"


@query(f"""SELECT o_orderkey, {_LAG} AS lag, CASE WHEN {_LAG} <= 2592000 THEN 'met' WHEN {_LAG} >= 7776000 THEN 'breach' ELSE 'warn' END AS slo
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""")
def lag_seconds_slo(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    lag = F.greatest(F.lit(0), F.unix_seconds(F.col("ship").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    rows = t.orders.join(first, "o_orderkey").select("o_orderkey", lag.alias("lag"))
    return rows.withColumn("slo", health.level(F.col("lag"), 2_592_000, 7_776_000))


_STATE = """CASE WHEN last IS NULL THEN 'never-indexed' WHEN c_acctbal < -500 THEN 'unknown' WHEN c_acctbal < 0 THEN 'diverged'
  WHEN n > 15 THEN 'behind' WHEN c_nationkey = 7 THEN 'tree-dirty' ELSE 'fresh' END"""
_CUST = "SELECT c_custkey, c_nationkey, c_acctbal, max(o_orderdate) AS last, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"


def _customers(t: Tables) -> DataFrame:
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal").join(seen, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bal = F.col("c_acctbal")
    return rows.withColumn("state", health.freshness_state(F.col("last"), bal >= -500, bal < 0, F.col("n") - 15, F.col("c_nationkey") == 7))


@query(f"SELECT c_custkey, {_STATE} AS state FROM ({_CUST})")
def freshness_state_case(t: Tables) -> DataFrame:
    return _customers(t).select("c_custkey", "state")


@query(f"""WITH c AS (SELECT c_nationkey, {_STATE} AS state, n FROM ({_CUST})),
  g AS (SELECT c_nationkey, count(*) FILTER (state <> 'fresh') AS stale, max(n) AS drift FROM c GROUP BY 1),
  l AS (SELECT *, CASE WHEN stale <= 5 THEN 'met' WHEN stale >= 40 THEN 'breach' ELSE 'warn' END AS a, CASE WHEN drift <= 10 THEN 'met' WHEN drift >= 30 THEN 'breach' ELSE 'warn' END AS b FROM g)
  SELECT c_nationkey, stale, drift, CASE WHEN 'breach' IN (a, b) THEN 'breach' WHEN 'warn' IN (a, b) THEN 'warn' ELSE 'met' END AS overall FROM l""")
def freshness_slo(t: Tables) -> DataFrame:
    g = _customers(t).groupBy("c_nationkey").agg(F.count_if(F.col("state") != "fresh").alias("stale"), F.max("n").alias("drift"))
    return g.withColumn("overall", health.worst(health.level(F.col("stale"), 5, 40), health.level(F.col("drift"), 10, 30)))


#: An event as an answer: its error, gaps, number of results and fallback.
_MISS = """CASE WHEN user_id % 13 = 0 THEN 'engine-error' WHEN user_id % 7 = 0 THEN 'wrong-intent' WHEN user_id % 11 = 0 THEN 'engine-error'
  WHEN value IS NULL OR value < 5 THEN 'missing-fact' WHEN event_type = 'error' OR event_id % 4 = 0 THEN 'missing-evidence' END"""


def _answers(t: Tables) -> DataFrame:
    user = F.col("user_id")
    gaps = F.when(user % 7 == 0, "Seed could not be resolved.").when(user % 11 == 0, "one; Semantic graph unavailable")
    fallback = F.when((F.col("event_type") == "error") | (F.col("event_id") % 4 == 0), "targeted-source").otherwise("none")
    miss = rules.miss_class(F.when(user % 13 == 0, "timeout"), gaps, F.when(F.col("value") < 5, 0).otherwise(F.col("value").cast("long")), fallback)
    return t.events.select("event_id", "event_type", miss.alias("miss"))


@query(f"SELECT event_id, {_MISS} AS miss FROM events")
def derive_miss_class(t: Tables) -> DataFrame:
    return _answers(t).select("event_id", "miss")


@query(f"""WITH c AS (SELECT event_type, coalesce({_MISS}, 'none') AS miss, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 4) AS rate FROM c""")
def classify_miss(t: Tables) -> DataFrame:
    counted = _answers(t).groupBy("event_type", F.coalesce("miss", F.lit("none")).alias("miss")).agg(F.count("*").alias("n"))
    return counted.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 4))


@query("""WITH v AS (SELECT (SELECT count(*) FILTER (quality = 1) / count(*) FROM labels) AS quality, (SELECT count(DISTINCT doc_id) FROM labels) / (SELECT count(*) FROM documents) AS coverage,
    (SELECT count(*) FILTER (toxic = 1) / count(*) FROM labels) AS toxic)
  SELECT CASE WHEN quality >= 0.8 AND coverage >= 0.3 AND toxic <= 0.2 THEN 'open' ELSE 'blocked' END AS decision,
    concat_ws(',', CASE WHEN coverage < 0.3 THEN 'coverage' END, CASE WHEN quality < 0.8 THEN 'quality' END, CASE WHEN toxic > 0.2 THEN 'toxic' END) AS failed FROM v""")
def gate_decision(t: Tables) -> DataFrame:
    share = t.labels.agg(F.avg((F.col("quality") == 1).cast("double")).alias("quality"), F.avg((F.col("toxic") == 1).cast("double")).alias("toxic"), F.countDistinct("doc_id").alias("d"))
    both = share.join(t.documents.agg(F.count("*").alias("n")))
    check = lambda name, value, threshold, at_least: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(threshold).alias("threshold"), F.lit(at_least).alias("at_least"))
    checks = F.array(check("quality", F.col("quality"), 0.8, True), check("coverage", F.col("d") / F.col("n"), 0.3, True), check("toxic", F.col("toxic"), 0.2, False))
    return health.gate(both.select(F.explode(checks).alias("c")).select("c.*"))


#: Documents as facts, labelled ones as made by a model; benchmark items as values of env files; conversations as telemetry.
_AUDIT = """f AS (SELECT d.doc_id AS id, coalesce(source, 'none') AS repository, text AS content, d.doc_id % 7 <> 0 AS active, CASE WHEN l.doc_id IS NULL THEN 'deterministic' ELSE 'ai' END AS producer,
    CAST(l.quality AS DOUBLE) AS quality, CASE WHEN toxic = 1 THEN 'observed' ELSE 'inferred' END AS confidence, TIMESTAMP '2026-01-01' + to_days(CAST(d.doc_id % 60 AS INTEGER)) AS updated_at
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  e AS (SELECT doc_id AS fact_id, CASE doc_id % 97 WHEN 1 THEN '/etc/x' WHEN 2 THEN '../y' ELSE 'src/a.ts' END AS file FROM documents WHERE doc_id % 5 <> 0),
  env AS (SELECT CASE item_id % 3 WHEN 0 THEN 'MODE_' ELSE 'API_KEY_' END || item_id AS key, substr(text, 1, 30) AS value FROM benchmark),
  n AS (
    SELECT 'I1-no-env-values' AS invariant, count(*) AS n FROM (SELECT DISTINCT key, t FROM env JOIN (SELECT 'facts' AS t, content FROM f UNION ALL SELECT 'telemetry', text FROM conversations) c
        ON (contains(key, 'API_KEY') AND contains(content, value)) OR content = value)
    UNION ALL SELECT 'I2-paths-inside-registry', (SELECT count(DISTINCT file) FROM e JOIN f ON id = fact_id WHERE active AND file <> 'src/a.ts') + (SELECT count(DISTINCT repository) FROM f WHERE repository IN ('src1', 'src2'))
    UNION ALL SELECT 'I3-made-facts-labelled', count(*) FROM f WHERE active AND producer = 'ai' AND (quality IS NULL OR confidence <> 'inferred' OR id NOT IN (SELECT fact_id FROM e))
    UNION ALL SELECT 'I4-telemetry-without-content', count(DISTINCT content) FROM f JOIN conversations ON text = content WHERE active AND length(content) >= 40
    UNION ALL SELECT 'I5-retention', (SELECT CAST(count(*) > 100 AS BIGINT) FROM conversations) + (SELECT CAST(count(*) > 0 AS BIGINT) FROM f WHERE NOT active AND updated_at < TIMESTAMP '2026-05-01' - to_days(90)))"""


@query(f"WITH {_AUDIT} SELECT invariant, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS n_findings FROM n")
def audit_invariants(t: Tables) -> DataFrame:
    n, days = F.col("doc_id"), F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    facts = t.documents.join(t.labels, "doc_id", "left").select(
        n.alias("id"),
        F.coalesce("source", F.lit("none")).alias("repository"),
        F.col("text").alias("content"),
        (n % 7 != 0).alias("active"),
        F.when(F.col("quality").isNull() & F.col("toxic").isNull(), "deterministic").otherwise("ai").alias("producer"),
        F.col("quality").cast("double").alias("quality"),
        F.when(F.col("toxic") == 1, "observed").otherwise("inferred").alias("confidence"),
        (F.lit("2026-01-01").cast("timestamp") + days).alias("updated_at"),
    )
    evidence = t.documents.where("doc_id % 5 <> 0").select(n.alias("fact_id"), F.when(n % 97 == 1, "/etc/x").when(n % 97 == 2, "../y").otherwise("src/a.ts").alias("file"))
    names = facts.select(F.col("repository").alias("name")).distinct()
    env = t.benchmark.select(F.concat(F.when(F.col("item_id") % 3 == 0, "MODE_").otherwise("API_KEY_"), F.col("item_id").cast("string")).alias("key"), F.substring("text", 1, 30).alias("value"))
    told = t.conversations.where("text is not null").select("text")
    return audit.invariants(facts, evidence, names, names.where("name not in ('src1', 'src2')"), told, env, 100, 90, F.lit("2026-05-01").cast("timestamp"))


@query("""WITH c AS (SELECT o_orderkey AS file FROM orders WHERE o_orderstatus <> 'F'), gone AS (SELECT o_orderkey AS file FROM orders WHERE o_orderstatus = 'P'),
  o AS (SELECT l_orderkey AS file, l_returnflag || l_linestatus AS hash, row_number() OVER (PARTITION BY l_orderkey, l_returnflag || l_linestatus) AS n FROM lineitem JOIN c ON file = l_orderkey WHERE l_linenumber <= 4),
  f AS (SELECT l_orderkey AS file, l_returnflag || l_linestatus AS hash, row_number() OVER (PARTITION BY l_orderkey, l_returnflag || l_linestatus) AS n FROM lineitem JOIN c ON file = l_orderkey WHERE l_linenumber >= 3 AND l_orderkey NOT IN (SELECT file FROM gone)),
  p AS (SELECT coalesce(o.file, f.file) AS file, CASE WHEN o.n IS NULL THEN 'create' WHEN f.n IS NULL THEN 'deactivate' ELSE 'reuse' END AS action FROM o FULL JOIN f ON o.file = f.file AND o.hash = f.hash AND o.n = f.n)
  SELECT file, action, count(*) AS n FROM p GROUP BY 1, 2""")
def incremental_sync(t: Tables) -> DataFrame:
    # Orders are files and their first four lines the facts so far; in a changed order the lines from the third on are read anew.
    lines = t.lineitem.select(F.col("l_orderkey").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("hash"), "l_linenumber")
    facts = lines.where("l_linenumber <= 4").select((F.col("file") * 10 + F.col("l_linenumber")).alias("id"), "file", "hash", F.lit(True).alias("active"))
    changed = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    fresh = lines.where("l_linenumber >= 3").join(changed.where("o_orderstatus <> 'P'"), "file", "left_semi")
    return sync.partition(facts, fresh, changed).groupBy("file", "action").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, sum(o_totalprice) AS baseline, sum(o_totalprice) * 0.4 AS engine, bool_and(o_orderstatus <> 'P') AS clean FROM orders GROUP BY 1)
  SELECT o_custkey, round(baseline - engine, 2) AS nominal, round(CASE WHEN clean THEN baseline - engine ELSE -engine END, 2) AS effective FROM c""")
def economy_ledger(t: Tables) -> DataFrame:
    cases = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("baseline"), (F.sum("o_totalprice") * 0.4).alias("engine"), F.bool_and(F.col("o_orderstatus") != "P").alias("clean"))
    out = health.ledger(cases)
    return out.select("o_custkey", F.round("nominal", 2).alias("nominal"), F.round("effective", 2).alias("effective"))


@query("""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  f AS (SELECT source, min(rank) FILTER (lang = 'de') AS first FROM r GROUP BY 1)
  SELECT round(count(*) FILTER (first <= 5) / count(*), 4) AS recall_at_5, round(count(*) FILTER (first <= 10) / count(*), 4) AS recall_at_10 FROM f""")
def recall_at_k(t: Tables) -> DataFrame:
    # The rank of a source's first hit is one more than the number of its rows that come before, so nothing is sorted.
    rows = t.documents.select("source", "lang", F.struct("n_chars", (-F.col("doc_id")).alias("neg")).alias("at"))
    best = rows.groupBy("source").agg(F.max(F.when(F.col("lang") == "de", F.col("at"))).alias("hit"))
    ahead = rows.join(best, "source").groupBy("source").agg(F.count_if(F.col("at") > F.col("hit")).alias("n"), F.first("hit").alias("hit"))
    first = ahead.select("source", F.when(F.col("hit").isNotNull(), F.col("n") + 1).alias("first"))
    within = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 4).alias(f"recall_at_{k}")
    return first.agg(within(5), within(10))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_debounce(t: Tables) -> DataFrame:
    sessions = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").alias("started"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_rollup(t: Tables) -> DataFrame:
    rolled = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rolled.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""WITH h AS (SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM events), x AS (SELECT event_id, hour AS start FROM h UNION ALL SELECT event_id, hour - INTERVAL 1 HOUR FROM h)
  SELECT start, count(*) AS n FROM x GROUP BY 1""")
def sliding_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
