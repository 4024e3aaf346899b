import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import snapshots, sync
from lodestrata.sources import versions

ROUTES = "repository string, route string, source_file string, rendering string"
GRAPH = "repository string, src string, dst string, type string"
FACTS = "repository string, type string, subject string, content string"


def tables(spark, routes, graph, facts):
    return {"routes": spark.createDataFrame(routes, ROUTES), "graph": spark.createDataFrame(graph, GRAPH), "facts": spark.createDataFrame(facts, FACTS)}


def some(seed):
    rng = random.Random(seed)
    r = lambda: rng.choice(["a", "b", "c"])
    routes = {(r(), f"/{rng.randrange(5)}", "f"): rng.choice(["static", None]) for _ in range(9)}
    graph = [(r(), f"m{rng.randrange(3)}", f"t{rng.randrange(3)}", rng.choice(["calls", "reads", "fetches", "tests"])) for _ in range(20)]
    facts = {(r(), "cache", f"s{rng.randrange(5)}"): rng.choice("xy") for _ in range(9)}
    return [(*k, v) for k, v in routes.items()], graph, [(*k, v) for k, v in facts.items()]


def plain_diff(old, new):
    """Both states as dictionaries and sets."""
    out = set()
    for section, i in (("routes", 0), ("facts", 2)):
        a, b = ({x[:3]: x[3] for x in rows[i]} for rows in (old, new))
        for k in a.keys() | b.keys():
            change = "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
            if change:
                out.add((section, k[0], " ".join(k[1:]), change))
    a, b = ({(r, f"{t} {s} {d}") for r, s, d, t in rows[1] if t != "tests"} for rows in (old, new))
    out |= {("flows", *x, "added") for x in b - a} | {("flows", *x, "removed") for x in a - b}
    for kind, section in (("reads", "config"), ("fetches", "api")):
        a, b = ({(r, d, s) for r, s, d, t in rows[1] if t == kind} for rows in (old, new))
        out |= {(section, r, d, "changed") for r, d, _ in a ^ b}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_are_restored_and_compared(spark, tmp_path, seed):
    path, old, new = f"file://{tmp_path}/t", some(seed), some(seed + 10)
    now = [[x for x in a if x[0] != "b"] + [x for x in b if x[0] == "b"] for a, b in zip(old, new, strict=True)]
    assert snapshots.commit(spark, path, "s1", ["a", "b", "c"], tables(spark, *old)) == 1
    files = set(tmp_path.rglob("*.parquet"))
    assert snapshots.commit(spark, path, "s2", ["b"], tables(spark, *new), after=1) == 2
    added = {f for f in tmp_path.rglob("*.parquet")} - files
    assert all(f"part={snapshots._folder('b')}" in str(f) for f in added)  # only what changed is written
    for version, state in ((1, old), (2, now), (None, now)):
        for name, rows in zip(("routes", "graph", "facts"), state, strict=True):
            assert sorted(map(str, map(tuple, snapshots.read(spark, path, name, version).collect()))) == sorted(map(str, rows))
    assert {tuple(r) for r in snapshots.behaviour_diff(spark, path, 1, 2).collect()} == plain_diff(old, now)
    assert snapshots.behaviour_diff(spark, path, 2, 2).collect() == []
    assert snapshots.version_of(spark, path, "s1") == 1 and snapshots.version_of(spark, path, "s9") is None
    assert {r.repository for r in snapshots.read(spark, path, "graph", 1, ["a"]).collect()} == {"a"}


def test_of_two_commits_one_fails(spark, tmp_path):
    path, state = f"file://{tmp_path}/t", some(3)
    snapshots.commit(spark, path, "s1", ["a", "b", "c"], tables(spark, *state))
    snapshots.commit(spark, path, "s2", ["a"], tables(spark, *some(4)), after=1)
    with pytest.raises(versions.Conflict):
        snapshots.commit(spark, path, "s3", ["b"], tables(spark, *some(5)), after=1)
    assert versions.newest(spark, path)[1]["sha"] == "s2"
    with pytest.raises(KeyError):
        snapshots.read(spark, path, "nothing")
    # The same for whole tables of a sync: both began from version 1.
    df, other = spark.range(3), f"file://{tmp_path}/u"
    sync.commit(other, facts=df)
    sync.commit(other, 1, facts=df.limit(1))
    with pytest.raises(versions.Conflict):
        sync.commit(other, 1, facts=df.limit(2))
    assert sync.read(spark, other, "facts").count() == 1 and sync.read(spark, other, "facts", 1).count() == 3


def test_a_repository_may_lose_all_its_rows(spark, tmp_path):
    path, state = f"file://{tmp_path}/t", some(6)
    snapshots.commit(spark, path, "s1", ["a", "b", "c"], tables(spark, *state))
    snapshots.commit(spark, path, "s2", ["a", "b"], {"facts": tables(spark, [], [], [])["facts"]})
    assert {r.repository for r in snapshots.read(spark, path, "facts").collect()} <= {"c"}
    assert snapshots.read(spark, path, "graph").count() == len(state[1])
    gone = snapshots.behaviour_diff(spark, path, 1, 2)
    assert gone.where(F.col("section") != "facts").count() == 0 and gone.select("change").distinct().collect()[0][0] == "removed"
