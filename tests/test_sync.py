from pyspark.sql import functions as F

from lodestrata.operators import audit, history, sync

FACTS = "id long, file string, hash string, active boolean, created_sha string, removed_sha string"


def test_sync_reuses_creates_and_closes(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = [(1, "a", "x", True, "s0", None), (2, "a", "x", True, "s0", None), (3, "a", "y", True, "s0", None), (4, "b", "z", True, "s0", None), (5, "c", "w", True, "s0", None), (6, "a", "x", False, "s0", "s0")]
    facts = spark.createDataFrame(rows, FACTS)
    nothing = sync.partition(facts, facts.limit(0), spark.createDataFrame([], "file string"))
    assert nothing.collect() == [] and sync.version(spark, path) is None
    assert sync.commit(path, facts=facts, audit=sync.audit(nothing, "s0")) == 1
    fresh = spark.createDataFrame([("a", "x"), ("a", "n"), ("a", "n"), ("d", "new")], "file string, hash string")
    files = spark.createDataFrame([("a",), ("b",), ("d",)], "file string")  # b was deleted
    assert sync.sync(spark, path, fresh, files, "s1") == 2
    now = {r.id: (r.file, r.hash, r.active, r.created_sha, r.removed_sha) for r in sync.read(spark, path, "facts").collect()}
    assert now == {
        1: ("a", "x", True, "s0", None),
        2: ("a", "x", False, "s0", "s1"),
        3: ("a", "y", False, "s0", "s1"),
        4: ("b", "z", False, "s0", "s1"),
        5: ("c", "w", True, "s0", None),
        6: ("a", "x", False, "s0", "s0"),
        7: ("a", "n", True, "s1", None),
        8: ("a", "n", True, "s1", None),
        9: ("d", "new", True, "s1", None),
    }
    actions = sorted((r.action, str(r.id), r.old_hash, r.new_hash) for r in sync.read(spark, path, "audit").collect())
    assert [a[0] for a in actions] == ["create"] * 3 + ["deactivate"] * 3 + ["reuse"] and actions[-1] == ("reuse", "1", "x", "x")
    sync.read(spark, path, "facts").limit(1).write.parquet(f"{path}/v=3/facts")  # a version that was never finished
    assert sync.version(spark, path) == 2
    vectors = spark.createDataFrame([(1,), (2,), (77,)], "id long")
    assert sorted(r.id for r in sync.missing_vectors(sync.read(spark, path, "facts"), vectors).collect()) == [5, 7, 8, 9]
    assert sorted(r.id for r in sync.orphan_vectors(sync.read(spark, path, "facts"), vectors).collect()) == [2, 77]


def test_deactivate_and_replace(spark):
    facts = spark.createDataFrame([(1, "a", "x", True, "s0", None), (2, "a", "y", True, "s0", None), (3, "b", "z", False, "s0", "s0")], FACTS)
    which = spark.createDataFrame([("a",), ("b",)], "file string")
    got = {r.id: (r.active, r.removed_sha) for r in sync.deactivate(facts, which, "file", "s1", facts.where("id = 2")).collect()}
    assert got == {1: (False, "s1"), 2: (True, None), 3: (False, "s0")}
    new = facts.where("id = 2").withColumn("hash", F.lit("new"))
    assert sorted((r.id, r.hash) for r in sync.replace_partition(facts, new, "file").collect()) == [(2, "new"), (3, "z")]


def test_supersession_by_key(spark):
    rows = [(1, "k", "accepted", None), (2, "k", "proposed", None), (3, "other", "accepted", "k"), (4, "j", "rejected", None), (5, "m", "proposed", "j")]
    df = spark.createDataFrame(rows, "id long, key string, status string, supersedes string")
    got = {r.id: (r.status, r.supersedes_id) for r in history.supersede_named(df, "key", "supersedes", "id").collect()}
    assert got == {1: ("accepted", None), 2: ("superseded", None), 3: ("accepted", 2), 4: ("rejected", None), 5: ("proposed", None)}


def test_history_helpers(spark):
    df = spark.createDataFrame([("a", None), (None, ""), ("", "a")], "x string, y string")
    assert df.select(history.content_hash("x", "y").alias("h")).distinct().count() == 3
    filled = history.with_defaults(df, {"y": "d", "z": 1}).collect()
    assert [(r.y, r.z) for r in filled] == [("d", 1), ("", 1), ("a", 1)]


def facts_for_audit(spark, rows):
    schema = "id long, repository string, content string, active boolean, producer string, quality double, confidence string, updated_at timestamp_ntz"
    return spark.createDataFrame(rows, schema).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def run_audit(spark, facts, evidence, telemetry, env, registry=("r",)):
    name = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    found = audit.invariants(
        facts,
        spark.createDataFrame(evidence, "fact_id long, file string"),
        name(["r"]),
        name(registry),
        spark.createDataFrame([(x,) for x in telemetry], "text string"),
        spark.createDataFrame(env, "key string, value string"),
        2,
        90,
        F.lit("2026-06-01").cast("timestamp"),
    )
    return {r.invariant[:2]: (r.status, r.n_findings) for r in found.collect()}


def test_audit(spark):
    clean = facts_for_audit(spark, [(1, "r", "plain fact", True, "deterministic", None, "observed", None), (2, "r", "made", True, "ai", 0.5, "inferred", None)])
    got = run_audit(spark, clean, [(1, "src/a.ts"), (2, "src/b.ts")], [], [])
    assert got == {"I1": ("skipped", 0), "I2": ("pass", 0), "I3": ("pass", 0), "I4": ("skipped", 0), "I5": ("pass", 0)}
    body = "a long fact content that telemetry must never repeat as it is"
    bad = facts_for_audit(
        spark,
        [
            (1, "r", "uses https://db.example.org/x in prose", True, "deterministic", None, "observed", None),
            (2, "r", body, True, "ai", None, "inferred", None),
            (3, "r", "development", False, "deterministic", None, None, None),
            (4, "r", "s3cr3t!value-here", True, "deterministic", None, None, None),
        ],
    ).withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    env = [("DB", "https://db.example.org/x"), ("MODE", "development"), ("APP_SECRET", "s3cr3t!value"), ("OTHER", "prose"), ("WORD", "content that")]
    got = run_audit(spark, bad, [(1, "/etc/passwd"), (4, "../x")], [f"x\t{body}", "two", "three"], env, registry=())
    assert got == {"I1": ("fail", 3), "I2": ("fail", 3), "I3": ("fail", 1), "I4": ("fail", 1), "I5": ("fail", 2)}


def test_registry_pass(spark):
    registry = spark.createDataFrame([("new", "h"), ("same", "h"), ("moved", "h2"), ("back", "h"), ("never", None), (None, "h")], "name string, head string")
    known = spark.createDataFrame([("same", "h", False), ("moved", "h", False), ("back", "h", True), ("never", None, False), ("gone", "h", False), ("long gone", "h", True)], "name string, last_sha string, retired boolean")
    done = lambda **options: {r.repository: r.action for r in sync.reconcile_registry(registry, known, **options).collect()}
    assert done() == {"new": "indexed", "never": "indexed", "same": "unchanged", "moved": "synced", "back": "restored", "gone": "retired"}
    assert done(check_commits=False, retire_missing=False) == {"new": "indexed", "never": "indexed", "back": "restored"}
