import posixpath
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import modules

ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def plain_resolve(file, specifier, files, paths):
    """One specifier of one repository, step by step."""
    if specifier.startswith(("./", "../")) or specifier in (".", ".."):
        path = posixpath.join(posixpath.dirname(file), specifier)
    else:
        met = [(not p.endswith("*"), len(p.rstrip("*")), t) for p, t in paths if (specifier.startswith(p[:-1]) if p.endswith("*") else specifier == p)]
        if not met:
            return None
        whole, length, target = max(met, key=lambda m: m[:2])
        path = target.rstrip("*") + ("" if whole else specifier[length:])
    parts = []
    for x in path.split("/"):
        if x == ".." and not parts:
            return None
        parts = parts[:-1] if x == ".." else parts + [x] * (x not in ("", "."))
    path = "/".join(parts)
    stem, end = posixpath.splitext(path)
    tried = [stem + e for e in ENDINGS[:2]] * (end in (".js", ".jsx", ".mjs", ".cjs")) + [path] * (end in (".ts", ".tsx", ".mts", ".cts", *ENDINGS) and not path.endswith(".d.ts"))
    tried += [path + e for e in ENDINGS] + [posixpath.join(path, "index") + e for e in ENDINGS]
    return next((x for x in tried if x in files and not x.endswith(".d.ts")), None)


def test_specifiers_equal_plain_steps(spark):
    rng = random.Random(2)
    name = lambda: rng.choice(["a", "b", "lib", "index", "x.test"])
    folder = lambda: "/".join(name() for _ in range(rng.randrange(3)))
    files = {posixpath.join(folder(), name() + rng.choice([*ENDINGS, ".d.ts"])) for _ in range(60)}
    paths = [("@/*", "lib/*"), ("@/a/*", "b/*"), ("~*", "*"), ("entry", "a/index.ts"), ("@/a", "lib")]
    some = lambda: posixpath.join(rng.choice([".", "..", "../..", "./..", "@", "@/a", "~", "react", "./."]), folder(), name() + rng.choice(["", "", ".js", ".ts", ".jsx"]))
    asked = [(rng.choice(sorted(files)), s) for s in [some() for _ in range(300)] + ["entry", "entry/a", "@/a", ".", "..", "~a", "", "../../../../a"]]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = modules.resolve(
        df([("r", *a) for a in asked] + [("q", "a/b.ts", "./c"), (None, "a", "b"), ("r", "a", None)], "repository string, file string, specifier string"),
        df([("r", f) for f in files] + [("q", "b.ts")], "repository string, file string"),
        df([("r", *p) for p in paths] + [(None, "x", "y")], "repository string, pattern string, target string"),
    ).collect()
    assert len(found) == len(set(asked)) + 1
    for r in found:
        assert r.module == (plain_resolve(r.file, r.specifier, files, paths) if r.repository == "r" else None), r


def plain_follow(module, name, own, links):
    """The nearest declaration, breadth first; else the end of the way by names."""
    named = lambda m, n: sorted(t for (a, b, *t) in links if (a, b) == (m, n))
    here, seen = {(module, name)}, {(module, name)}
    for hop in range(7):
        if done := sorted(here & own):
            return (*done[0], hop)
        step = set()
        for m, n in here:
            by_name = named(m, n)
            step |= {tuple(t) for t in by_name} if by_name else {(t, n) for t, _ in named(m, "*") if n != "default"}
        here = step - seen
        seen |= here
    at, met, hop = (module, name), {(module, name)}, 0
    while hop < 6 and named(*at) and tuple(named(*at)[0]) not in met:
        at, hop = tuple(named(*at)[0]), hop + 1
        met.add(at)
    return (*at, hop)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_equal_plain_walks(spark, seed):
    rng = random.Random(seed)
    m, n = lambda: f"m{rng.randrange(14)}", lambda: rng.choice(["x", "y", "default"])
    own = {(m(), n()) for _ in range(6)}
    links = {(m(), n()): (m(), n()) for _ in range(14)} | {(f"m{i}", "*"): (m(), None) for i in rng.sample(range(14), 6)}
    rows = [(a, b, t, i) for (a, b), (t, i) in links.items()] + [("m3", "*", "m4", None), ("m3", "*", "m5", None)]
    asked = sorted({(m(), n()) for _ in range(30)})
    df = lambda rows, schema: spark.createDataFrame([("r", *x) for x in rows], "repository string, " + schema)
    found = modules.follow(df(asked + asked[:3], "module string, name string"), df(own, "file string, name string"), df(rows, "file string, name string, target string, imported string")).collect()
    assert {(r.module, r.name): (r.declared_in, r.declared_name, r.hops) for r in found} == {a: plain_follow(*a, own, rows) for a in asked}
    assert len(found) == len(asked)


def test_six_hops_and_empty_tables(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    chain = [("r", f"m{i}", "x", f"m{i + 1}", "x") for i in range(9)]
    names, own = df([("r", "m0", "x"), ("r", "m3", "x")], "repository string, module string, name string"), df([("r", "m9", "x")], "repository string, file string, name string")
    found = modules.follow(names, own, df(chain, "repository string, file string, name string, target string, imported string")).collect()
    assert {(r.module, r.declared_in, r.hops) for r in found} == {("m0", "m6", 6), ("m3", "m9", 6)}
    none = df([], "repository string, file string, name string, target string, imported string")
    assert [r.declared_in for r in modules.follow(names.limit(1), own, none).collect()] == ["m0"]
    assert modules.resolve(df([], "repository string, file string, specifier string"), own, df([], "repository string, pattern string, target string")).collect() == []


def test_files_name_the_paths_that_mean_them(spark):
    rng = random.Random(5)
    names = ["a", "index", "a/index", "/index", "", "a.d", "x/a.b", "a/index/index"]
    paths = sorted({n + e for n in names for e in ["", *ENDINGS, ".mjsx", ".cjsx", ".cts", ".d.ts", ".js.ts"]})
    files = sorted({f for p in rng.sample(paths, 40) for f in (p, p + ".ts", p + "/index.js")} | {f"a/index{e}" for e in ENDINGS} | {p + ".tsx" for p in paths})
    both = spark.createDataFrame([(p,) for p in paths], "path string").crossJoin(spark.createDataFrame([(f,) for f in files], "file string"))
    forward = both.select("path", "file", F.posexplode(F.array(*modules.candidates(F.col("path")))).alias("rank", "module")).where("module = file").select("path", "file", "rank")
    back = spark.createDataFrame([(f,) for f in files], "file string").select("file", F.inline(modules.meant_by(F.col("file")))).where(F.col("path").isin(paths))
    want = {tuple(r) for r in forward.collect()}
    got = [tuple(r) for r in back.select("path", "file", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in want} == set(range(15))


def test_modules_without_their_imports_equal_resolve(spark):
    imports = spark.createDataFrame([("r", f"{d}/f{i}.ts", s) for d in ("a", "b") for i in range(20) for s in ("./x", "../a/x", "@/x", "@/none", "react")], "repository string, file string, specifier string")
    files = spark.createDataFrame([("r", "a/x.ts"), ("r", "b/x/index.ts"), ("r", "b/x.d.ts"), ("q", "a/none.ts")], "repository string, file string")
    paths = spark.createDataFrame([("r", "@/*", "a/*")], "repository string, pattern string, target string")
    found = modules.resolve(imports, files, paths)
    assert found.count() == 200 and found.where("module is null").count() == 80
    got = [tuple(r) for r in modules.imported(imports, files, paths).collect()]
    assert sorted(got) == sorted({(r.repository, r.module) for r in found.where("module is not null").collect()}) == [("r", "a/x.ts"), ("r", "b/x/index.ts")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "posexplode" not in plan  # files name paths; imports are never multiplied by their candidates


def test_many_files_are_exchanged_however_small_their_table(spark, tmp_path):
    number = spark.range(60_000).withColumn("repository", F.lit("r"))
    number.select("repository", "id").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files").select("repository", F.format_string("src/f%d.ts", "id").alias("file"))
    imports = number.where("id < 50").select("repository", F.lit("src/a.ts").alias("file"), F.format_string("@/f%d", F.col("id") + 59_980).alias("specifier"))
    found = modules.resolve(imports, files, spark.createDataFrame([("r", "@/*", "src/*")], "repository string, pattern string, target string"))
    assert sorted(r.module for r in found.where("module is not null").collect()) == sorted(f"src/f{i}.ts" for i in range(59_980, 60_000))
    assert found.count() == 50 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_aliases_are_exchanged(spark, monkeypatch):
    plans, stored = [], modules.stored
    monkeypatch.setattr(modules, "BROADCAST_NAMES", 3, raising=False)
    monkeypatch.setattr(modules, "stored", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or stored(df, tag))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    imports = df([("r", "a.ts", f"@{i}/x") for i in range(6)], "repository string, file string, specifier string")
    files = df([("r", f"src{i}/x.ts") for i in range(5)], "repository string, file string")
    paths = df([("r", f"@{i}/*", f"src{i}/*") for i in range(6)], "repository string, pattern string, target string")
    found = modules.resolve(imports, files, paths).collect()
    assert {(r.specifier, r.module) for r in found} == {(f"@{i}/x", f"src{i}/x.ts") for i in range(5)} | {("@5/x", None)}
    assert [plan.count("BroadcastHashJoin") for tag, plan in plans if tag == "paths"] == [0]


def test_names_are_followed_without_broadcasts(spark, monkeypatch):
    plans, stored = [], modules.stored
    monkeypatch.setattr(modules, "BROADCAST_NAMES", -1)
    monkeypatch.setattr(modules, "stored", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, tag))
    own = {("m3", "x"), ("m6", "y")}
    links = [("m0", "*", "m1", None), ("m0", "*", "m2", None), ("m0", "y", "m5", "z"), ("m1", "x", "m3", "x"), ("m2", "*", "m0", None), ("m5", "z", "m6", "y"), ("m4", "x", "m5", "w")]
    asked = [("m0", "x"), ("m0", "y"), ("m0", "z"), ("m1", "x"), ("m4", "x"), ("m6", "y"), ("m7", "x")]
    df = lambda rows, schema: spark.createDataFrame([("r", *x) for x in rows], "repository string, " + schema)
    found = modules.follow(df(asked, "module string, name string"), df(own, "file string, name string"), df(links, "file string, name string, target string, imported string"))
    rows = {(r.module, r.name): (r.declared_in, r.declared_name, r.hops) for r in found.collect()}
    assert rows == {a: plain_follow(*a, own, links) for a in asked} and rows["m0", "x"] == ("m3", "x", 2)
    assert not any("BroadcastHashJoin" in plan for plan in [*plans, found._jdf.queryExecution().executedPlan().toString()])
