"""The trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from lodestrata.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def brute(rows):
    found = rebuilt(rows)
    members = {}
    for c, path in found.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(found[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt_sequences(spark.createDataFrame(rows, SCHEMA)))
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


def some(seed, n, words="ab", most=12):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for turn in range(rnd.randrange(1, most)):
            rows.append((c, rnd.choice([turn, turn, turn, None]), rnd.choice(["user", None]), rnd.choice([*words, None, "é" * 3])))
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "n", "words"), [(1, 25, "a"), (2, 30, "ab"), (3, 20, "abcdef")])
def test_against_dictionaries(spark, seed, n, words):
    rows = some(seed, n, words)
    assert got(spark, rows) == brute(rows)


def test_copies_packed_in_runs_and_tries_handed_on(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 3)
    monkeypatch.setattr(prefix_trie, "LIMIT", 4)
    rows = [(c, t, "user", "hello") for c in range(40) for t in range(3)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert got(spark, []) == []
    rows = [(None, 1, "user", "x"), (3, None, None, None), (-7, 0, "user", "y"), (-10, 0, "user", "z"), (4, 1, "user", "long " * 50_000)]
    assert got(spark, rows) == brute(rows)


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"{t}") for c in (10, 11) for t in range(1500)]
    found = got(spark, rows)
    assert len(found) == 1501 and max(r[1] for r in found) == 1500


@pytest.mark.parametrize("seed", range(20))
def test_exit_nodes(seed):
    """The node where a path leaves the trie, against a look at every node."""
    rnd = random.Random(seed)
    paths = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 20))) for _ in range(40)]
    hashes = lambda p: [hashlib.md5(p[:d].encode()).digest() for d in range(1, len(p) + 1)]
    trie = prefix_trie.Trie()
    for i, p in enumerate(paths):
        x = hashes(p)
        shared = [n for n in trie.nodes if n.a < len(x) and n.path[n.a] == x[n.a]]
        assert trie.exit(x) is max(shared, key=lambda n: n.a, default=trie.root)
        trie.insert(x, [1] * len(x), 1, i)
    edges = {(n.a, n.path[n.b - 1]) for n in trie.nodes}
    assert len(edges) == len(trie.nodes) and all(n.a < n.b for n in trie.nodes)
    rows = {(r[0], r[2]): r[5] for r in trie.expanded()}
    for p in set(paths):
        for d in range(len(p) + 1):
            key = (hashlib.md5(p[:d].encode()).digest() if d else prefix_trie.ROOT, d)
            assert rows[key] == sum(q[:d] == p[:d] for q in paths)


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)
