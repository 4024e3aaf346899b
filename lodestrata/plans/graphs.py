"""Graphs: orders, parts, suppliers, nations and regions as nodes, their references as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import matcher_regex, terms, url_path
from lodestrata.operators import graph, health, relational
from lodestrata.plans import query
from lodestrata.sources.storage import small
from lodestrata.sources.tables import Tables

_EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def _edges(t: Tables) -> DataFrame:
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    parts = [
        link(t.customer, "c", "c_custkey", "n", "c_nationkey"),
        link(t.nation, "n", "n_nationkey", "r", "n_regionkey"),
        link(t.orders, "o", "o_orderkey", "c", "o_custkey"),
        link(t.supplier, "s", "s_suppkey", "n", "s_nationkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query(f"""WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'n3', 0 UNION SELECT src, depth + 1 FROM walk JOIN edges ON dst = node WHERE depth < 8)
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1""")
def graph_impact_bfs(t: Tables) -> DataFrame:
    # What depends on nation 3: edges are followed against their direction.
    back = _edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = t.nation.where("n_nationkey = 3").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.reach(back, seeds, 8)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'calls' AS type, CAST(o_orderkey % 97 AS INTEGER) AS line FROM orders
    UNION SELECT DISTINCT 's' || l_suppkey, 'o' || l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'reads' ELSE 'fetches' END, CAST(l_linenumber AS INTEGER) FROM lineitem),
  seed AS (SELECT 'c' || c_custkey AS seed FROM customer),
  d1 AS (SELECT seed, src AS affected, min((line, dst, type)) AS ev FROM seed JOIN e ON dst = seed GROUP BY ALL),
  d2 AS (SELECT seed, src AS affected, min((line, dst, e.type)) AS ev FROM d1 JOIN e ON dst = affected GROUP BY ALL),
  a AS (SELECT seed, affected, 1 AS depth, ev FROM d1 UNION ALL SELECT seed, affected, 2, ev FROM d2)
  SELECT seed, affected, depth, ev[2] AS dependency, ev[3] AS via, ev[1] AS line FROM a""")
def impact_evidence(t: Tables) -> DataFrame:
    # Orders depend on their customers, suppliers on the orders whose lines they serve; what does each customer's change reach?
    kind = lambda c: F.lit(c)
    calls = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("calls").alias("type"), (F.col("o_orderkey") % 97).cast("int").alias("line"))
    uses = t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("src"),
        F.concat(F.lit("o"), "l_orderkey").alias("dst"),
        F.when(F.col("l_returnflag") == "R", "reads").otherwise("fetches").alias("type"),
        F.col("l_linenumber").cast("int").alias("line"),
    )
    edges = calls.unionByName(uses).withColumns({"file": kind("f"), "src_kind": kind("function"), "dst_kind": kind("function")})
    seeds = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("seed"))
    return graph.impact(edges, seeds, 2).where("depth > 0").select("seed", "affected", "depth", "dependency", "via", "line")


@query(f"""WITH {_EDGES}, two AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src)
  SELECT src, count(*) AS n_reach FROM two WHERE src <> dst GROUP BY 1""")
def graph_two_hop_reach(t: Tables) -> DataFrame:
    return graph.two_hop(_edges(t))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
  walk(node) AS (SELECT min(p_partkey) FROM part UNION SELECT dst FROM walk JOIN e ON src = node) SELECT CAST(node AS BIGINT) AS node FROM walk""")
def graph_transitive_closure(t: Tables) -> DataFrame:
    # Every line leads from its part to its supplier's number, which is a part's number again.
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.closure(edges, t.part.agg(F.min("p_partkey").alias("node")))


_ALIAS = "a AS (SELECT o_orderkey AS name, o_orderkey // 3 AS target FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"""WITH {_ALIAS}, r0 AS (SELECT o_orderkey AS name, o_orderkey AS t FROM orders), r1 AS (SELECT r0.name, coalesce(a.target, t) AS t FROM r0 LEFT JOIN a ON a.name = t),
  r2 AS (SELECT r1.name, coalesce(a.target, t) AS t FROM r1 LEFT JOIN a ON a.name = t), r3 AS (SELECT r2.name, coalesce(a.target, t) AS t FROM r2 LEFT JOIN a ON a.name = t),
  r4 AS (SELECT r3.name, coalesce(a.target, t) AS t FROM r3 LEFT JOIN a ON a.name = t), r5 AS (SELECT r4.name, coalesce(a.target, t) AS t FROM r4 LEFT JOIN a ON a.name = t)
  SELECT r5.name, coalesce(a.target, t) AS target FROM r5 LEFT JOIN a ON a.name = t""")
def iterative_alias_resolution(t: Tables) -> DataFrame:
    aliases = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("name"), F.floor(F.col("o_orderkey") / 3).alias("target"))
    return graph.resolve_aliases(t.orders.select(F.col("o_orderkey").alias("name")), aliases)


@query()
def graph_flow_dfs(t: Tables) -> DataFrame:
    # Each nation is a repository: customers call their orders, orders fetch their lines' suppliers.
    calls = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("repository"),
        F.concat(F.lit("c"), "c_custkey").alias("src"),
        F.concat(F.lit("o"), "o_orderkey").alias("dst"),
        F.lit("calls").alias("type"),
        (F.col("o_orderkey") % 97).cast("int").alias("line"),
    )
    owner = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    fetches = t.lineitem.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("c_nationkey").cast("string").alias("repository"),
        F.concat(F.lit("o"), "l_orderkey").alias("src"),
        F.concat(F.lit("s"), "l_suppkey").alias("dst"),
        F.when(F.col("l_returnflag") == "R", "reads").otherwise("fetches").alias("type"),
        "l_linenumber",
    )
    edges = calls.unionByName(fetches.withColumnRenamed("l_linenumber", "line"))
    seeds = t.customer.select(F.col("c_nationkey").cast("string").alias("repository"), F.concat(F.lit("c"), "c_custkey").alias("seed"))
    return graph.flows(edges, seeds)


@query("""WITH n AS (SELECT DISTINCT p_partkey AS node, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')) AS term FROM part),
  q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]{3,}')) AS term FROM part WHERE p_partkey <= 3),
  e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
  w AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
  own AS (SELECT node, count(DISTINCT term) AS own FROM n JOIN q USING (term) GROUP BY 1),
  ar AS (SELECT src AS node, count(DISTINCT term) AS around FROM w JOIN n ON n.node = w.dst JOIN q USING (term) WHERE src <> dst GROUP BY 1),
  sz AS (SELECT src AS node, count(*) AS n_reach FROM w WHERE src <> dst GROUP BY 1)
  SELECT node, 4 * coalesce(own, 0) + 2 * coalesce(around, 0) AS score, coalesce(n_reach, 0) AS n_reach
  FROM own FULL JOIN ar USING (node) LEFT JOIN sz USING (node) WHERE 4 * coalesce(own, 0) + 2 * coalesce(around, 0) > 0""")
def seed_scoring(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.explode(terms(F.col("p_name"), stop=("",))).alias("term"))
    asked = nodes.where("node <= 3").select("term")
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.seed_scores(nodes, asked, edges)


@query("""WITH w AS (SELECT o_custkey AS k, o_orderkey AS name, epoch_us(o_orderdate) // 86400000000 AS s, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 90 AS e FROM orders),
  p AS (SELECT event_id, user_id AS k, epoch_us(ts) // 86400000000 AS d FROM events),
  j AS (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY e - s, name) AS n FROM p LEFT JOIN w ON p.k = w.k AND d BETWEEN s AND e)
  SELECT event_id, name AS holder FROM j WHERE n = 1""")
def interval_join_smallest_span(t: Tables) -> DataFrame:
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000)
    spans = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("name"), day("o_orderdate").alias("s"))
    spans = spans.withColumn("e", F.col("s") + F.col("name") % 90)
    points = t.events.select("event_id", F.col("user_id").alias("k"), day("ts").alias("at"))
    return relational.smallest_span(points, spans, "k", "at", "s", "e", "name", 90).select("event_id", "holder")


@query("""WITH r(pattern, area) AS (VALUES ('^/(en|de)(/|$)', 'content'), ('^/fr', 'french'), ('/[0-9]+/?$', 'numbered')),
  p AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages)
  SELECT page_id, area FROM p JOIN r ON regexp_matches(path, pattern)""")
def theta_regex_join(t: Tables) -> DataFrame:
    rules = [("^/(en|de)(/|$)", "content"), ("^/fr", "french"), ("/[0-9]+/?$", "numbered")]  # a fixed list, so no join is needed
    path = url_path(F.col("url"))
    hit = F.array(*[F.when(path.rlike(p), F.lit(a)) for p, a in rules])
    return t.pages.select("page_id", F.explode(F.array_compact(hit)).alias("area"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages)
  SELECT page_id, regexp_matches(path, '^/en(?:/[^/]+)*/?$') AS english, regexp_matches(path, '^/[^/]+/[^/]+/?$') AS two_parts FROM p""")
def middleware_matchers(t: Tables) -> DataFrame:
    path = url_path(F.col("url"))
    hit = lambda pattern: path.rlike(matcher_regex(pattern))
    return t.pages.select("page_id", hit("/en/:rest*").alias("english"), hit("/:lang/:id").alias("two_parts"))


@query("""WITH b AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') AS phrase FROM benchmark),
  d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS t FROM documents)
  SELECT item_id, count(doc_id) AS n_docs FROM b LEFT JOIN d ON contains(t, ' ' || phrase || ' ') GROUP BY 1""")
def theta_phrase_contains(t: Tables) -> DataFrame:
    # The hash of a phrase's first words, up to six, meets the hashes of the documents' windows of as many words in an equi-join;
    # what meets is compared whole. An item without words is found, as in SQL, in documents without words.
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    listed = t.benchmark.select("item_id", words.alias("w"))
    lengths = [r[0] for r in listed.where("w is not null").select(F.least(F.size("w"), F.lit(6))).distinct().collect()]  # 0 to 6
    first = F.coalesce(*[F.when(F.least(F.size("w"), F.lit(6)) == n, F.xxhash64(F.lit(n), *[F.get("w", F.lit(k)) for k in range(n)])) for n in lengths], F.lit(None).cast("long"))
    items = listed.select("item_id", F.array_join("w", " ").alias("phrase"), first.alias("start"))
    phrases = small(items.where("start is not null").select("phrase", "start").distinct())

    def windows(n: int):
        if not n:
            return F.when(F.size("w") == 0, F.array(F.xxhash64(F.lit(0))))
        start = lambda i: F.xxhash64(F.lit(n), *[F.get("w", i + k) for k in range(n)])
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), start))

    starts = [windows(n) for n in lengths]
    docs = t.documents.select("doc_id", words.alias("w")).where("w is not null")
    none = F.array().cast("array<bigint>")
    all_starts = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, none) for x in starts]))) if starts else none
    # Numbers alone are repeated; texts are fetched for the documents that meet a phrase. An outer explode, as a plain one would
    # also be planned as a filter of non-empty arrays, by which they are computed twice.
    texts = docs.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("text")).withColumn("row", F.xxhash64("text"))
    begun = docs.select(F.xxhash64(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("row"), all_starts.alias("starts"))
    met = begun.select("row", F.explode_outer("starts").alias("start")).join(phrases, "start").select("row", "phrase").distinct()
    found = texts.join(met, "row").where(F.contains("text", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).groupBy("phrase").agg(F.count("doc_id").alias("n"))
    return items.join(found, "phrase", "left").groupBy("item_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:password|token|secret)\\s*=\\s*"?([A-Za-z0-9]{16,})', 1)) AS value FROM documents)
  SELECT doc_id, value, length(text) - length(replace(text, value, '')) >= 2 * length(value) AS again FROM documents JOIN s ON contains(text, value)""")
def leak_substring_scan(t: Tables) -> DataFrame:
    # Known secrets are alphanumeric, so they lie in alphanumeric runs: their first 16 characters meet the windows of 16 of all
    # runs in an equi-join. Every secret of a text is known, also beyond its first, which alone the SQL takes.
    secret = r'(?:password|token|secret)\s*=\s*"?([A-Za-z0-9]{16,})'
    known = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(secret), F.lit(1))).alias("value")).distinct()
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{16,}"), F.lit(0))
    windows = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 15), lambda i: run.substr(i, F.lit(16)))
    rows = t.documents.where(F.col("text").rlike("[A-Za-z0-9]{16}")).select("doc_id", "text", F.xxhash64("text").alias("row"))
    starts = rows.select("doc_id", "row", F.explode_outer(F.array_distinct(F.flatten(F.transform(runs, windows)))).alias("start"))
    hits = starts.join(known.withColumn("start", F.substring("value", 1, 16)), "start").select(F.col("doc_id").alias("id"), F.col("row").alias("at"), "value").distinct()
    found = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("at"))).where(F.contains("text", F.col("value")))
    again = F.length("text") - F.length(F.replace("text", F.col("value"), F.lit(""))) >= 2 * F.length("value")
    return found.select("doc_id", "value", again.alias("again"))


@query("""WITH e AS (SELECT doc_id, regexp_extract(text, '^(\\S+)', 1) AS quote, len(string_split(text, chr(10))) AS n_lines, text FROM documents)
  SELECT doc_id, CASE WHEN length(quote) < 3 THEN 'quote-too-short' WHEN n_lines < 2 THEN 'no-line-range'
    WHEN NOT contains(string_split(text, chr(10))[2], quote) THEN 'quote-not-in-range' ELSE 'accepted' END AS verdict FROM e""")
def evidence_gate(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    quote = F.regexp_extract("text", r"^(\S+)", 1)
    verdict = (
        F.when(F.length(quote) < 3, "quote-too-short")
        .when(F.size(lines) < 2, "no-line-range")
        .when(~F.contains(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), quote), "quote-not-in-range")
        .otherwise("accepted")
    )
    return t.documents.select("doc_id", verdict.alias("verdict"))


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS needle FROM benchmark),
  f AS (SELECT DISTINCT source, needle FROM (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS needle FROM documents) JOIN n USING (needle))
  SELECT s.source, (SELECT count(*) FROM n) AS n_expected, count(f.needle) AS n_found, round(count(f.needle) / (SELECT count(*) FROM n), 4) AS recall
  FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN f ON f.source IS NOT DISTINCT FROM s.source GROUP BY 1""")
def eval_recall(t: Tables) -> DataFrame:
    # Each source is a case that should hold the words of all benchmark items.
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    return health.token_recall(t.benchmark.select(F.explode(words).alias("needle")), t.documents.select("source", words.alias("w")), "source", "w")
