import random
from collections import Counter

import pytest

from lodestrata.operators import renames

SCHEMA = "path string, text string"


def shared(a, b):
    x, y = Counter(a.split("\n")), Counter(b.split("\n"))
    weight = lambda c: sum(n * (len(s.encode()) + 1) for s, n in c.items())
    return weight(x & y), max(weight(x), weight(y))


def brute(before, after):
    """One pair after another, most alike first."""
    old, new = dict(before), dict(after)
    out = [("M", p, None, None) for p in old if p in new and old[p] != new[p]]
    gone, fresh = sorted(p for p in old if p not in new), sorted(p for p in new if p not in old)
    for p in list(gone):
        same = next((q for q in fresh if new[q] == old[p]), None)
        if same is not None:
            out.append(("R", same, p, 100))
            gone.remove(p), fresh.remove(same)
    first = lambda names, texts: {p: min(q for q in names if texts[q] == texts[p]) for p in names}
    a, b, pairs = first(gone, old), first(fresh, new), []
    for p in gone:
        for q in fresh:
            n, most = shared(old[p], new[q])
            if 2 * n >= most and old[p] and new[q]:
                pairs.append((-(100 * n // most), a[p], b[q], p, q))
    for score, _, _, p, q in sorted(pairs):
        if p in gone and q in fresh:
            out.append(("R", q, p, -score))
            gone.remove(p), fresh.remove(q)
    return sorted(out + [("A", q, None, None) for q in fresh] + [("D", p, None, None) for p in gone], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["{", "}", "", "import a", f"line {rng.randrange(40)}", f"a longer line with the number {rng.randrange(40)}"])
    before = {f"a{i}": "\n".join(line() for _ in range(rng.randrange(12))) for i in range(22)}
    before |= {f"c{i}": before["a0"] for i in range(4)} | {f"d{i}": "{\n}\n{" for i in range(3)}
    after = {}
    for i, (path, text) in enumerate(before.items()):
        lines = text.split("\n")
        for _ in range(rng.randrange(3)):
            lines[rng.randrange(len(lines))] = line()
        kept = "\n".join(lines)
        after[path if i % 4 == 0 else f"b{rng.randrange(100)}"] = rng.choice([text, kept, kept])
    after |= {f"e{i}": "{\n}\n{\nx" for i in range(2)}
    df = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    got = sorted((tuple(r) for r in renames.changes(df(before), df(after)).collect()), key=str)
    assert got == brute(before.items(), after.items())


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = spark.createDataFrame([("a", None), (None, "x"), ("b", "text"), ("b", "text")], SCHEMA)
    assert renames.changes(none, none).collect() == []
    assert sorted(map(tuple, renames.changes(none, rows).collect())) == [("A", "a", None, None), ("A", "b", None, None)]
    assert sorted(map(tuple, renames.changes(rows, none).collect())) == [("D", "a", None, None), ("D", "b", None, None)]
    moved = spark.createDataFrame([("z", ""), ("y", "text")], SCHEMA)
    assert sorted(map(tuple, renames.changes(rows, moved).collect())) == [("R", "y", "b", 100), ("R", "z", "a", 100)]


def test_hot_lines_make_no_pairs(spark):
    """Files that share a license but little else: their pairs don't meet."""
    license_ = "\n".join(f"license line {i}" for i in range(5))
    text = lambda i, k: license_ + "\n" + "\n".join(f"own line {i} {j} {k if j > 7 else 0} of a file" for j in range(10))
    pair = lambda k: spark.createDataFrame([(f"h{i}", text(i, k)) for i in range(60)], "hash string, text string")
    left, right = renames._lines(pair(1)), renames._lines(pair(2))
    order = left.select("line", "hash").union(right.select("line", "hash")).groupBy("line").count().withColumnRenamed("count", "spread")
    met = renames._first_lines(left, order).withColumnRenamed("hash", "a").join(renames._first_lines(right, order).withColumnRenamed("hash", "b"), "line")
    assert met.select("a", "b").distinct().count() == 60 == renames.alike(pair(1), pair(2)).count()


def test_contents_are_told_by_32_bytes(spark):
    rows = renames._files(spark.createDataFrame([("a", "x"), ("b", None)], "path string, text string")).collect()
    assert all(len(r.hash) == 32 for r in rows)
