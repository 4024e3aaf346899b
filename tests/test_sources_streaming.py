from pyspark.sql import functions as F

from lodestrata.operators import sync
from lodestrata.sources import files
from lodestrata.streaming import events as ev


def test_walk_and_facts(spark, tmp_path):
    for name, body in {
        "src/a.ts": "import x from './x'\nexport const value = 1\nexport default function Page() {}\n",
        "src/b.css": "p{}",
        "node_modules/m/i.js": "x",
        "lib/c.tsx": "const y = require('y')\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: r for r in files.walk(spark, f"file://{tmp_path}").select("path", files.imports(F.col("text")).alias("i"), files.exports(F.col("text")).alias("e")).collect()}
    assert set(got) == {"src/a.ts", "lib/c.tsx"}
    assert got["src/a.ts"].i == ["./x"] and got["src/a.ts"].e == ["value", "Page"] and got["lib/c.tsx"].i == ["y"]


def test_walk_by_kinds_and_paths(spark, tmp_path):
    for name in ("src/a.d.ts", "src/a.ts", "gen/b.ts", "Dockerfile.dev", "tsconfig.json", "src/app/package.json", "dist/c.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    root = f"file://{tmp_path}"
    assert [r.path for r in files.walk(spark, root, ignored_paths=["gen"]).collect()] == ["src/a.ts"]
    assert {r.path for r in files.walk(spark, root, exclude=None).collect()} == {"src/a.ts", "src/a.d.ts", "gen/b.ts"}
    assert {r.path for r in files.walk(spark, root, files.PROJECT_FILES).collect()} == {"Dockerfile.dev", "tsconfig.json", "src/app/package.json"}


def test_json_and_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"repositories": [{"name": "shop", "url": "git@h.org:t/shop.git", "queryAliases": {"/x": ["y"]}}, {"name": "shop", "url": "other"}, {"name": "blog", "mainBranch": "dev"}, {"url": "no name"}]}')
    got = {r.name: (r.url, r.main_branch, r.aliases) for r in files.registry(spark, f"file://{tmp_path}/r.json").collect()}
    assert got == {"shop": ("git@h.org:t/shop.git", "main", {"/x": ["y"]}), "blog": (None, "dev", None)}
    (tmp_path / "bad.json").write_text("{not json")
    assert [r.a for r in files.read_json(spark, f"file://{tmp_path}/bad.json", "a string").collect()] == [None]
    assert files.read_json(spark, f"file://{tmp_path}/bad.json", "a string", strict=True).collect() == []


def test_ancestors(spark):
    commits = spark.createDataFrame([("d", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("a", []), ("x", ["a"])], "sha string, parents array<string>")
    assert {r.sha for r in files.commits_above(commits, "d").collect()} == {"a", "b", "c", "d"}


def test_pushes(spark):
    registry = spark.createDataFrame([("shop", "https://h.org/t/shop", "main"), ("blog", "git@h.org:t/blog.git", "dev")], "name string, url string, main_branch string")
    sha, zero = "ab" * 20, "0" * 40
    bodies = {
        "ok": f'{{"seq": 1, "repository": "shop", "commit": "{sha}"}}',
        "ok ": f'{{"seq": 2, "ref": "refs/heads/dev", "after": "{sha}", "pusher": {{"name": "a"}}, "repository": {{"ssh_url": "ssh://git@h.org/t/blog"}}}}',
        "ok  ": f'{{"seq": 3, "object_kind": "push", "ref": "refs/heads/main", "checkout_sha": "{sha}", "project": {{"git_http_url": "https://h.org/T/Shop.git"}}}}',
        "ignored": f'{{"seq": 4, "repository_name": "shop", "ref": "refs/heads/x", "commit": "{sha}"}}',
        "unknown": f'{{"seq": 5, "repository_name": "none", "commit": "{sha}"}}',
        "no-commit": '{"seq": 6, "repository_name": "shop", "commit": "abc"}',
        "deletion": f'{{"seq": 7, "repository_name": "shop", "after": "{zero}"}}',
        "malformed": "[not json",
    }
    rows = ev.pushes(spark.createDataFrame([(b,) for b in bodies.values()], "body string"), registry).collect()
    assert [r.status for r in rows] == [k.strip() for k in bodies]
    assert [(r.repository, r.source) for r in rows[:3]] == [("shop", "generic"), ("blog", "github"), ("shop", "gitlab")]


def test_pushes_as_a_stream_and_once(spark, tmp_path):
    registry = spark.createDataFrame([("shop", "https://h.org/t/shop", "main")], "name string, url string, main_branch string")
    for k in (1, 1, 2):
        body = f'{{"seq": {k}, "repository": "shop", "commit": "{str(k) * 40}"}}'
        spark.createDataFrame([(body, "2026-01-01 00:00:00")], "body string, ts string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    stream = ev.read_stream(spark, f"{tmp_path}/p", spark.read.parquet(f"{tmp_path}/p").schema)
    got = drained(ev.pushes(stream, registry), "t3", "append", spark).collect()
    assert sorted((r.seq, r.status) for r in got) == [(1, "ok"), (1, "ok"), (2, "ok")]
    assert drained(ev.once(stream, "body"), "t4", "append", spark).count() == 2


def test_package_dependencies(spark):
    text = '{"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}, "peerDependencies": {"c": "4"}}'
    df = spark.createDataFrame([("r", text), ("broken", "{")], "repository string, text string")
    assert {tuple(r) for r in files.package_dependencies(df).collect()} == {("r", "a", "1", "runtime"), ("r", "b", "3", "development"), ("r", "c", "4", "peer")}


def test_changed_files(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "5")], "path string, hash string")
    assert {tuple(r) for r in files.changed_files(before, after).collect()} == {("b", None, "M"), ("d", "c", "R"), ("e", None, "A")}


def test_env_keys(spark):
    row = spark.createDataFrame([("A=1\nexport B_2 = x\n#C=3\n",)], "t string").select(files.env_keys(F.col("t")).alias("k")).first()
    assert row.k == ["A", "B_2"]


def stream_of(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    return events, ev.read_stream(spark, f"{tmp_path}/in", events.schema)


def drained(query_df, name, mode, spark):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events, stream = stream_of(spark, sf_dir, tmp_path)
    batch = {(r.start, r.event_type): r.n for r in ev.tumbling(events).collect()}
    rows = drained(ev.tumbling(stream, delay="3650 days"), "t1", "complete", spark).collect()
    assert {(r.start, r.event_type): r.n for r in rows} == batch


def test_state_per_user(spark, sf_dir, tmp_path):
    events, stream = stream_of(spark, sf_dir, tmp_path)
    rows = drained(ev.running_miss_rate(stream), "t2", "update", spark).groupBy("user_id").agg(F.max("n").alias("n"), F.max("misses").alias("m")).collect()
    expected = events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("m")).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in expected}


def test_commits_are_idempotent(spark, tmp_path):
    rows = [("r", 1, "a"), ("r", 3, "c"), ("r", 2, "b"), ("q", 1, "x")]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "repository string, seq long, sha string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    stream = ev.read_stream(spark, f"{tmp_path}/c", spark.read.parquet(f"{tmp_path}/c").schema)
    ev.apply_commits(stream, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in sync.read(spark, f"{tmp_path}/table", "commits").collect()} == {("r", 3, "c"), ("q", 1, "x")}
    # A stream with a new checkpoint begins from the newest version: what it reads again, and older commits, change nothing.
    ev.apply_commits(stream, f"{tmp_path}/table", f"{tmp_path}/cp2").awaitTermination()
    assert {tuple(r) for r in sync.read(spark, f"{tmp_path}/table", "commits").collect()} == {("r", 3, "c"), ("q", 1, "x")}
