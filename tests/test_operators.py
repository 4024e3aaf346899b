import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestrata.operators import budget, graph, health, history, relational, search

EDGES = [
    ("r", "use#derive", "base#value", "references", 4),
    ("r", "View#View", "use#derive", "calls", 8),
    ("r", "page#Page", "View#View", "renders", 6),
    ("r", "use#derive", "GET /items", "fetches", 12),
    ("r", "base#value", "API_URL", "reads", 2),
]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "repository string, src string, dst string, type string, line int")


def test_reverse_impact(spark):
    back = edges(spark).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = spark.createDataFrame([("base#value",)], "node string")
    got = {r.node: r.depth for r in graph.reach(back, seeds, 8).collect()}
    assert got == {"base#value": 0, "use#derive": 1, "View#View": 2, "page#Page": 3}
    assert {r.node for r in graph.reach(back, seeds, 1).collect()} == {"base#value", "use#derive"}


def test_cycles_end(spark):
    loop = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src long, dst long")
    assert graph.closure(loop, spark.createDataFrame([(0,)], "node long")).count() == 5


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(66)], "src long, dst long").coalesce(1).persist()
    assert graph.closure(chain, spark.createDataFrame([(0,)], "node long")).count() == 67


FLOW = [
    ("r", "page", "log", "calls", 1),
    ("r", "log", "meta", "calls", 2),
    ("r", "page", "svc", "calls", 3),
    ("r", "svc", "fetch", "calls", 4),
    ("r", "svc", "meta", "calls", 5),
    ("r", "fetch", "GET /x", "fetches", 5),
    ("r", "fetch", "URL", "reads", 5),
]


def flow(spark, rows, seed="page", **options):
    seeds = spark.createDataFrame([("r", seed)], "repository string, seed string")
    return graph.flows(edges(spark, rows), seeds, **options).orderBy("step").collect()


def test_flow_order_and_revisits(spark):
    got = flow(spark, FLOW)
    assert [(r.depth, r.dst) for r in got] == [(0, "log"), (1, "meta"), (0, "svc"), (1, "fetch"), (2, "GET /x"), (2, "URL"), (1, "meta")]
    short = flow(spark, FLOW, max_steps=2)
    assert [r.dst for r in short] == ["log", "meta"] and short[0].truncated and not got[0].truncated


def test_flow_leaves_out_what_leads_to_nothing(spark):
    rows = [
        ("r", "a.ts#page", "a.ts#help", "calls", 1),
        ("r", "a.ts#help", "a.ts#inner", "calls", 2),
        ("r", "a.ts#page", "a.ts#load", "calls", 3),
        ("r", "a.ts#load", "GET /x", "fetches", 4),
        ("r", "a.ts#page", "KEY", "reads", 5),
        ("r", "a.ts#page", "b.ts#T", "references", 6),
    ]
    got = flow(spark, rows, "a.ts#page")
    assert [r.dst for r in got] == ["a.ts#load", "GET /x", "KEY"] and got[0].pruned == 3
    data = flow(spark, rows, "a.ts#page", focus="data")
    assert [r.dst for r in data] == ["a.ts#load", "GET /x"] and data[0].pruned == 4


def test_flow_goes_on_in_route_handlers(spark):
    rows = [("r", "form", "/api/save", "submits-to", 1), ("r", "api.ts#POST", "upstream", "fetches", 2), ("r", "api.ts#helper", "other", "fetches", 2)]
    exports = spark.createDataFrame([("r", "api.ts", "api.ts#POST"), ("r", "api.ts", "api.ts#helper")], "repository string, file string, entry string")
    routes = spark.createDataFrame([("r", "/api/save", "api.ts")], "repository string, route string, source_file string")
    entries = graph.route_entries(exports, routes)
    assert [r.entry for r in entries.collect()] == ["api.ts#POST"]
    got = flow(spark, rows, "form", entries=entries)
    assert [(r.dst, r.depth, r.boundary) for r in got] == [("/api/save", 0, True), ("upstream", 1, False)]
    assert [r.dst for r in flow(spark, rows, "form")] == ["/api/save"]


def test_flow_bounds(spark):
    chain = [("r", f"n{i}", f"n{i + 1}", "calls", 1) for i in range(20)]
    assert len(flow(spark, chain, "n0", max_depth=3)) == 4
    wide = [("r", "hub", f"leaf{i:03}", "calls", i) for i in range(100)]
    got = flow(spark, wide, "hub", max_steps=10, max_explore=30)
    assert len(got) == 10 and got[0].truncated


def test_flows_of_many_seeds_in_one_task(spark, monkeypatch):
    # Each seed is walked by itself wherever batches and outputs are cut, missing lines come first, and a task is no group of pandas rows.
    monkeypatch.setattr(graph, "STEPS", 7)
    chains = [("r", f"p{i}", f"q{i}", "calls", 2) for i in range(30)] + [("r", f"q{i}", "GET /x", "fetches", 1) for i in range(30)]
    rows = [*chains, ("r", "p3", "GET /y", "fetches", None), ("s", "p3", "URL", "reads", 1), ("r", "q5", "p5", "calls", 9)]
    seeds = spark.createDataFrame([("r", f"p{i}") for i in range(30)] + [("s", "p3"), ("r", "none"), ("r", "p4")], "repository string, seed string")
    found = graph.flows(edges(spark, rows), seeds)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("step").collect():
        got.setdefault((r.repository, r.seed), []).append((r.depth, r.dst))
    want = {("r", f"p{i}"): [(0, f"q{i}"), (1, "GET /x")] for i in range(30)} | {("s", "p3"): [(0, "URL")]}
    want["r", "p3"] = [(0, "GET /y"), *want["r", "p3"]]
    want["r", "p5"] = [*want["r", "p5"], (1, "p5")]
    assert got == want


IMPACT = [
    ("use.ts#derive", "base.ts#value", "references", 4, "use.ts", "function", "function"),
    ("View.tsx#View", "use.ts#derive", "calls", 8, "View.tsx", "component", "function"),
    ("View.tsx#View", "base.ts#value", "renders", 9, "View.tsx", "component", "function"),
    ("page.tsx#Page", "View.tsx#View", "renders", 6, "page.tsx", "component", "component"),
    ("use.ts#derive", "GET /items", "fetches", 12, "use.ts", "function", "backend-endpoint"),
    ("use.ts#derive", "API_URL", "reads", 13, "use.ts", "function", "config"),
    ("use.ts#derive", "use.test.ts", "validated-by", 1, "use.ts", "function", "test"),
    ("base.ts#value", "BASE", "reads", 1, "base.ts", "function", "config"),
]


def test_impact_with_evidence_and_classes(spark):
    e = spark.createDataFrame(IMPACT, "src string, dst string, type string, line int, file string, src_kind string, dst_kind string")
    seeds = spark.createDataFrame([("base.ts#value",), ("use.ts",), ("BASE",)], "seed string")
    found = graph.impact(e, seeds)
    got = {(r.seed, r.affected): (r.depth, r.via, r.dependency, r.line) for r in found.collect()}
    assert got["base.ts#value", "use.ts#derive"] == (1, "references", "base.ts#value", 4)
    assert got["base.ts#value", "View.tsx#View"] == (1, "renders", "base.ts#value", 9)
    assert got["base.ts#value", "page.tsx#Page"] == (2, "renders", "View.tsx#View", 6)
    assert got["use.ts", "use.ts#derive"][0] == 0 and got["use.ts", "View.tsx#View"] == (1, "calls", "use.ts#derive", 8)
    routes = spark.createDataFrame([("/shop", "page.tsx", "page"), ("/api", "use.ts", "route-handler")], "route string, source_file string, route_type string")
    classes = {}
    for r in graph.impact_classes(found, e, routes).collect():
        classes.setdefault((r.seed, r["class"]), set()).add(r.name)
    assert classes["use.ts", "file"] == {"use.ts", "View.tsx", "page.tsx"} and classes["use.ts", "test"] == {"use.test.ts"}
    assert classes["use.ts", "endpoint"] == {"GET /items"} and classes["use.ts", "config"] == {"API_URL"}
    assert classes["use.ts", "route"] == {"/shop", "/api"} and classes["use.ts", "api-route"] == {"/api"}
    assert classes["BASE", "config"] == {"BASE"}  # not the keys that the same modules read besides
    assert classes["base.ts#value", "component"] == {"View.tsx#View", "page.tsx#Page"}
    assert {r.affected for r in graph.impact(e, seeds, max_depth=1).where("seed = 'BASE'").collect()} == {"BASE", "base.ts#value"}


def test_aliases_follow_hops(spark):
    links = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(10)], "name string, target string")
    names = spark.createDataFrame([("a0",), ("a7",), ("x",)], "name string")
    assert {r.name: r.target for r in graph.resolve_aliases(names, links).collect()} == {"a0": "a6", "a7": "a10", "x": "x"}


def test_reconcile_twice_is_a_no_op(spark):
    seen = spark.createDataFrame([("/a", "x"), ("/b", None)], "route string, mode string")
    old = spark.createDataFrame([("/b", "y", "s0", None, True), ("/c", "z", "s0", None, True), ("/d", "z", "s0", "s0", False)], "route string, mode string, created_sha string, removed_sha string, active boolean")
    first = history.reconcile(old, seen, ["route"], "s1")
    expected = {("/a", "x", "s1", None, True), ("/b", None, "s0", None, True), ("/c", "z", "s0", "s1", False), ("/d", "z", "s0", "s0", False)}
    assert {tuple(r) for r in first.collect()} == expected
    assert {tuple(r) for r in history.reconcile(first, seen, ["route"], "s2").collect()} == expected


def test_diff_and_snapshot(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    after = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k long, v string")
    assert {tuple(r) for r in history.diff(before, after, ["k"], ["v"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}
    path = f"file://{tmp_path}/snap"
    assert history.append_snapshot(before, path, "s1") and not history.append_snapshot(after, path, "s1")
    assert spark.read.parquet(f"{path}/sha=s1").count() == 3


def test_relational(spark):
    left = spark.createDataFrame([("x", 1), ("y", 9), ("z", 1)], "k string, f int")
    right = spark.createDataFrame([("x", 1, 5), ("x", 2, 3), ("y", 2, 7)], "k string, f int, id int")
    assert {r.k: r.match for r in relational.exact_else_any(left, right, ["k"], ["f"], "id").collect()} == {"x": 5, "y": 7, "z": None}
    a = spark.createDataFrame([("h", 1), ("h", 2), ("g", 3)], "h string, s int")
    b = spark.createDataFrame([("h", 10), ("i", 11)], "h string, f int")
    assert {tuple(r) for r in relational.multiset_match(a, b, "h", "s", "f").collect()} == {("h", 1, 10), ("h", 2, None), ("g", 3, None), ("i", None, 11)}


@pytest.mark.parametrize(("values", "p50"), [([1], 1), ([1, 2, 3, 4], 3), ([5, 5, 5, 9], 5), ([3, 1, 2], 2)])
def test_nearest_rank(spark, values, p50):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert relational.nearest_rank_by(df, ["k"], "v", {"p": 0.5}).first().p == p50
    assert df.agg(relational.nearest_rank(F.collect_list("v"), 0.5)).first()[0] == p50


def test_canonical_group(spark):
    rows = [("GATEWAY", ".env", 1), ("GATEWAY", "src/lib/gateway.ts", 2), ("GATEWAY", "src/x.ts", 3), ("ONLY", ".env", 1)]
    df = spark.createDataFrame(rows, "subject string, file string, at int")
    got = {r.subject: (r.anchor, r.others) for r in relational.merge_groups(df, ["subject"], F.col("file").startswith(".env"), "file", "at").collect()}
    assert got == {"GATEWAY": ("src/lib/gateway.ts", [".env", "src/x.ts"]), "ONLY": (".env", [])}


def test_smallest_span_holds_ties_and_gaps(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("f", 999)], "file string, line long")
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 4, 6, "inner"), ("g", 1, 9999, "other")], "file string, a long, b long, name string")
    got = {r.line: r.holder for r in relational.smallest_span(points, spans, "file", "line", "a", "b", "name", 10).collect()}
    assert got == {5: "inner", 50: "outer", 999: None}


def test_search(spark):
    rows = [(1, "cache rules"), (2, "cache cache"), (3, "Other text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "doc_id", "text", ["cache"]).collect()}
    assert set(got) == {1, 2} and got[2] > got[1]
    assert [r.doc_id for r in search.phrase_match(docs, "doc_id", "text", ["cache", "rules"]).collect()] == [1]
    assert abs(sum(search.WEIGHTS.values()) - 1) < 1e-9


def test_prefiltered_knn_stays_inside(spark):
    df = spark.createDataFrame([(1, "cache", [1.0, 0.0]), (2, "security", [1.0, 0.0]), (3, "cache", [0.0, 1.0])], "vec_id long, kind string, embedding array<float>")
    got = search.knn(df, [1.0, 0.0], 5, F.col("kind") == "cache").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(1, 0.0), (3, pytest.approx(2**0.5))]


def test_entities_and_dedupe(spark):
    rows = [(1, "r", "configuration", "GATEWAY:12", 0.5), (2, "r", "dependency", "config:GATEWAY", 0.7), (3, "r", "rendering", "route:/home", 0.6), (4, "r", "cache", "s", 0.7), (5, "q", "configuration", "GATEWAY", 0.1)]
    df = spark.createDataFrame(rows, "id long, repository string, kind string, subject string, score double")
    df = df.withColumn("entity", search.entity_key(F.col("repository"), F.col("kind"), F.col("subject")))
    got = [tuple(r) for r in search.rank_dedupe(df, "entity", "score", "id", 10).collect()]
    assert got == [("r:cache:s", 4, 0.7, 0), ("r:config:GATEWAY", 2, 0.7, 1), ("r:route:/home", 3, 0.6, 0), ("q:config:GATEWAY", 5, 0.1, 0)]


def test_union_keeps_best_rank(spark):
    hits = lambda rows: spark.createDataFrame(rows, "id long, rank int")
    got = {r.id: (r.channels, r.best_rank, r.ranks) for r in search.union_channels(("a", hits([(1, 3), (1, 2)])), ("b", hits([(1, 5), (2, 1)]))).collect()}
    assert got == {1: (["a", "b"], 2, {"a": 2, "b": 5}), 2: (["b"], 1, {"b": 1})}


def test_budgets(spark):
    df = spark.createDataFrame([("k", 1, 50), ("k", 2, 60), ("k", 3, 40), ("big", 1, 500)], "key string, at int, size int")
    assert {(r.key, r.at) for r in budget.prefix_within(df, "key", "at", "size", 100).collect()} == {("k", 1), ("big", 1)}
    assert {r.key: (r.used, r.picked) for r in budget.skip_within(df, "key", "at", "size", 100).collect()} == {"k": (90, [1, 3]), "big": (0, [])}


def test_gate(spark):
    rows = [("a", 0.9, 0.8, True), ("b", 0.3, 0.2, False)]
    schema = "name string, value double, threshold double, at_least boolean"
    assert tuple(health.gate(spark.createDataFrame(rows, schema)).first()) == ("blocked", "b")
    assert health.gate(spark.createDataFrame(rows[:1], schema)).first().decision == "open"
    assert health.gate(spark.createDataFrame([("a", None, 0.8, True)], schema)).first().decision == "insufficient-evidence"


def test_reach_and_terms_within_two_hops_against_loops(spark, monkeypatch):
    rng = random.Random(3)
    rows = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(300)} | {(1, 2), (2, 1), (50, 50), (51, 52), (52, 51)}) + [(None, 1), (1, None)]
    names = [f"t{i}" for i in range(130)]
    held = [(n, t) for n in [*range(60), 70] for t in rng.sample(names, 2)]
    asked = names[:125]
    df = spark.createDataFrame(rows, "src long, dst long")
    out = {}
    for a, b in rows:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    within = {a: {y for x in b for y in {x} | out.get(x, set())} - {a} for a, b in out.items()}
    expect = {a: len(b) for a, b in within.items() if b}
    terms = {}
    for n, t in held:
        if t in asked:
            terms.setdefault(n, set()).add(t)
    score = {n: 4 * len(terms.get(n, ())) + 2 * len(set().union(*[terms.get(x, set()) for x in within.get(n, ())])) for n in {*terms, *within}}
    for steps, edges_ in ((4_000_000, 1_000_000), (20, 40)):
        monkeypatch.setattr(graph, "BLOCK_STEPS", steps)
        monkeypatch.setattr(graph, "BLOCK_EDGES", edges_)
        assert {r.src: r.n_reach for r in graph.two_hop(df).collect()} == expect
        got = graph.seed_scores(spark.createDataFrame(held, "node long, term string"), spark.createDataFrame([(t,) for t in asked], "term string"), df).collect()
        assert {r.node: (r.score, r.n_reach) for r in got} == {n: (s, expect.get(n, 0)) for n, s in score.items() if s}


def test_reach_exchanges_no_pairs_of_two_hops(spark):
    edges_ = spark.range(40).crossJoin(spark.range(40).withColumnRenamed("id", "dst")).select(F.col("id").alias("src"), "dst")
    plan = graph.two_hop(edges_)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[src" not in plan and "FlatMapCoGroups" in plan


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "PART_ROWS", 7)
    monkeypatch.setattr(relational, "TASK_PAIRS", 500)
    rows = [("k", i) for i in range(100)] + [("l", 3), ("l", 3), ("m", None), (None, 1)]
    df = relational.pairs_within(spark.createDataFrame(rows, "k string, v long"), "k", "v", "a", "b")
    assert sorted(map(str, df.collect())) == sorted(str(Row(k=k, a=a, b=b)) for k, a in rows for j, b in rows if k is not None and k == j)
    tasks = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 8 and max(tasks) < 3_000


def test_percentiles_broadcast_counts_and_not_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = relational.nearest_rank_by(df, ["k"], "id", {"p": 0.5})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 3
    assert {r.k: r.p for r in got.collect()} == {0: 501, 1: 499, 2: 500}
