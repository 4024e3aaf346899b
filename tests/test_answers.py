import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search
from lodestrata.plans import answers

FACTS = [
    (1, "shop", "configuration", "GATEWAY_URL", "Gateway address is read in src/lib/gateway.ts", "observed", "src/lib/gateway.ts", "s1", None, 1, 1),
    (2, "shop", "dependency", "config:GATEWAY_URL", "gateway declared", "inferred", ".env", "s1", None, 1, 0),
    (3, "shop", "rendering", "route:/home", "Static page", "derived", "src/app/home/page.tsx", "s0", 0.3, 1, 1),
    (4, "other", "configuration", "GATEWAY_URL", "Gateway of another repository", "observed", "src/x.ts", None, None, 1, 0),
]
SCHEMA = (
    "id long, repository string, kind string, subject string, content string, confidence string, source_file string, commit_sha string, "
    "quality double, n_evidence int, n_located int"
)


def facts_of(spark):
    return spark.createDataFrame(FACTS, SCHEMA).selectExpr("*", "'s1' as repository_sha")


def test_context_ranks_dedupes_and_fits(spark):
    facts = facts_of(spark)
    got = answers.context(facts, "Where is the gateway url read?", "shop").collect()
    assert [r.id for r in got] == [1]
    assert all(0 <= r.score <= 1 for r in got)
    both = answers.context(facts, "gateway or static page", "shop", max_chars=60).collect()
    assert len(both) == 1 and both[0].used <= 60
    assert answers.context(facts, "completely unrelated words", "shop").collect() == []
    assert answers.context(facts, "", "shop").collect() == []
    assert [r.id for r in answers.context(facts, "gateway url").collect()] == [1, 4]  # facts of two repositories are two


def test_hybrid_features(spark):
    facts = facts_of(spark)
    every = facts.selectExpr("id", "array('sql') as channels", "1 as best_rank")
    rank = lambda question, types=(): [(r.entity, r.id, r.n_duplicates) for r in search.hybrid(facts, every, question, 10, types).collect()]
    assert rank("How is /home rendered?")[0] == ("shop:route:/home", 3, 0)
    named = rank("Where is GATEWAY_URL read?")
    assert named[0] == ("shop:config:GATEWAY_URL", 1, 1) and named[1][0] == "other:config:GATEWAY_URL"
    assert rank("GATEWAY_URL", ["rendering"]) == [("shop:route:/home", 3, 0)]
    with pytest.raises(ValueError, match="freshness"):
        search.score({n: F.lit(0.0) for n in search.WEIGHTS if n != "freshness"})
    quality = facts.select(search.evidence_quality(F.col("confidence"), F.col("quality"), F.lit(True), F.col("n_located") > 0, F.col("source_file").startswith(".env")).alias("q"))
    assert [round(r.q, 2) for r in quality.collect()] == [0.95, 0.1, 0.3, 0.75]


def test_hybrid_keeps_its_order_and_facts_without_names(spark):
    facts, every = facts_of(spark), None
    more = facts.where("id = 1").withColumns({"id": F.lit(90).cast("long"), "repository": F.lit(None).cast("string")})
    more = more.unionByName(facts.where("id = 1").withColumns({"id": F.lit(91).cast("long"), "subject": F.lit(None).cast("string")}))
    both = facts.unionByName(more)
    every = both.select("id", F.array(F.lit("sql")).alias("channels"), F.lit(1).alias("best_rank"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = search.hybrid(both, every, "cache rules", 50).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert {90, 91} <= {r.id for r in rows}


def test_phrases_of_a_question():
    assert search.phrases('Is "/cart/[id]" or API_URL in next-auth? Özgür', ["car loan"]) == [
        ("api", "url"), ("car", "loan"), ("cart",), ("id",), ("in",), ("is",), ("next", "auth"), ("or",), ("ozgur",),
    ]


def test_bm25_counts_phrases(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c b"), (3, "b a")], "id long, t string")
    assert {r.doc_id for r in search.bm25(docs, "id", "t", [("a", "b")]).collect()} == {1}
    assert {r.doc_id for r in search.bm25(docs, "id", "t", [("a", "b"), "c"]).collect()} == {1, 2}


def test_links(spark):
    repos = spark.createDataFrame([("design", "@c/design"), ("shop", None), ("blog", "@c/blog")], "name string, package_name string")
    deps = spark.createDataFrame([("shop", "@c/design", "runtime"), ("design", "@c/design", "peer"), ("blog", "react", "runtime")], "repository string, package_name string, kind string")
    got = {r.name: (r.outgoing, r.incoming) for r in answers.repository(repos, deps).collect()}
    assert got == {"design": ([], ["shop"]), "shop": (["design"], []), "blog": ([], [])}
    assert answers.repository(repos, deps, "shop").count() == 1


def test_route(spark):
    rows = [("r", "/Hesap/[id]", "static", "a.tsx", True, None), ("r", "/old", "static", "b.tsx", False, None)]
    df = spark.createDataFrame(rows, "repository string, route string, rendering string, source_file string, active boolean, auth_required boolean")
    assert [r.route for r in answers.route(df, "/hesap/[ID]/").collect()] == ["/Hesap/[id]"]
    assert answers.route(df).count() == 1
    assert "auth_required" in answers.route(df, detail="runtime").columns and "auth_required" not in answers.route(df).columns
