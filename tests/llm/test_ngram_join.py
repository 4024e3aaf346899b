import random
import re

import numpy as np
import pytest

from lodestrata.llm import ngram_join as nj


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    change = True
    while change:
        change = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    change = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def near_copies(seed, groups=12):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 9, 14, 40, 90, 200]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(documents, n, num, den):
    rows = near_copies(n)
    got = nj.ngram_jaccard_components(documents(rows), n, num, den).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute(rows, n, num, den)


def test_offered_segments_lose_no_linked_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(2, 300))
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = a[int(rng.integers(0, 1 + size // 12)) :]
        b = np.r_[b, rng.integers(0, 2**64, int(rng.integers(0, 1 + size // 12)), dtype=np.uint64)]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(nj.offered(a, 85, 100), nj.offered(b, 85, 100)))


def test_hamming_distance_bounds_symmetric_difference():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    b = np.unique(np.r_[a[10:], rng.integers(0, 2**64, 15, dtype=np.uint64)])
    x, y = nj.folded_sketch(a), nj.folded_sketch(b)
    assert len(x) == len(y)
    assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


def test_odd_rows(odd):
    got = nj.ngram_jaccard_components(odd.withColumn("id", odd.doc_id).withColumn("key", odd.text)).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 3, 1]
    assert by[5].component_id == 4 and by[4].component_id == 4 and by[1].component_id == 1
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_empty_table(documents):
    assert nj.ngram_jaccard_components(documents([])).collect() == []


def test_keys_met_once_and_sketches_of_no_pair_stay_in_place(spark, monkeypatch):
    from lodestrata.llm import ngram_join

    plans, kept = {}, ngram_join.stored

    def stored(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, tag)

    monkeypatch.setattr(ngram_join, "stored", stored)
    text = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, " ".join(text[::-1])), (4, None)]
    found = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert "min(id" not in plans["met"] and "count(1)" in plans["met"]
    assert "LeftSemi" in plans["close"]


def test_unlike_sets_share_no_key_by_chance():
    rng = np.random.default_rng(5)
    keys = [nj.offered(np.unique(rng.integers(0, 2**64, 66, dtype=np.uint64)), 80, 100) for _ in range(6000)]
    assert len(np.unique(np.concatenate(keys))) == sum(len(k) for k in keys)


def test_sketches_have_two_to_four_bits_a_member():
    rng = np.random.default_rng(6)
    for n in (3, 40, 128, 200, 255, 5000):
        assert 2 * n <= 64 * len(nj.folded_sketch(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))) <= max(64, 4 * n)


def test_rounds_are_given_open_buckets_of_three_and_more(documents, monkeypatch):
    given, kept = {}, nj.stored

    def stored(df, tag):
        df = kept(df, tag)
        given.setdefault(tag, []).append(df)
        return df

    monkeypatch.setattr(nj, "stored", stored)
    base = [f"w{i}" for i in range(300)]
    changed = lambda k, x: " ".join(f"{x}{i}" if i < k else w for i, w in enumerate(base))
    two = [(1, changed(0, "")), (2, changed(60, "x"))]  # some keys in common, and no link
    assert [r.component_id for r in nj.ngram_jaccard_components(documents(two)).orderBy("doc_id").collect()] == [1, 2]
    assert given["buckets"][0].count() > 0
    assert given["apart"][0].count() == 0
    given.clear()
    rows = [*two, (3, changed(60, "y")), (4, changed(61, "y")), (5, changed(4, "x")), (6, changed(120, "z"))]
    assert {r[0]: (r[1], r[2]) for r in nj.ngram_jaccard_components(documents(rows)).collect()} == brute(rows, 4, 85, 100)
    assert 0 < given["apart"][0].count() < given["buckets"][0].count()


def just_apart(seed, size):
    """Near copies of one text, most pairs of which have somewhat more differences than linked ones may."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        text = [f"w{k}" for k in range(400)]
        for k in rng.sample(range(3, 397, 4), 5):
            text[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("block_sets", [8192, 17])
def test_pairs_of_large_buckets_make_no_rows(documents, monkeypatch, block_sets):
    given, kept = {}, nj.stored

    def stored(df, tag):
        df = kept(df, tag)
        given.setdefault(tag, []).append(df)
        return df

    monkeypatch.setattr(nj, "stored", stored)
    monkeypatch.setattr(nj, "ROUNDS", 1)
    monkeypatch.setattr(nj, "FEW", 4, raising=False)
    monkeypatch.setattr(nj, "BLOCK_SETS", block_sets, raising=False)
    rows = just_apart(7, 120)
    got = {r[0]: (r[1], r[2]) for r in nj.ngram_jaccard_components(documents(rows)).collect()}
    assert got == brute(rows, 4, 85, 100)
    assert 1 < len({c for _, c in got.values()}) < 60
    assert sum(df.count() for tag in ("more", "joined") for df in given.get(tag, [])) < 240


def test_forest_joins_what_links_join():
    rows = near_copies(8) + [(1000 + i, t) for i, t in just_apart(9, 30)]
    raw = [t.encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, raw)])
    sets = list(nj.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, 4))
    ids = np.array([i for i, _ in rows])
    want = brute(rows, 4, 85, 100)
    equal = {}  # equal sets are one class before
    comps = np.array([equal.setdefault(s.tobytes(), i) for s, i in zip(sets, ids, strict=True)])

    def joined(links):
        comp = dict(zip(ids.tolist(), comps.tolist(), strict=True))
        for a, b in links:
            x, y = sorted((comp[a], comp[b]))
            assert x != y
            comp = {i: x if c == y else c for i, c in comp.items()}
        return comp

    links = nj.forest(ids, comps, np.zeros(len(ids), int), sets, 85, 100)
    assert joined(links) == {i: c for i, (_, c) in want.items()}
    sides = np.arange(len(ids)) % 2
    across = nj.forest(ids, comps, sides, sets, 85, 100)
    side = dict(zip(ids.tolist(), sides.tolist(), strict=True))
    assert across and all(side[a] != side[b] for a, b in across)


def test_large_buckets_of_the_same_members_are_one_cell(spark):
    chain = [(1, i) for i in range(1, 21)] + [(2, i) for i in range(20, 40)]
    same = [(key, i) for key in (3, 4) for i in range(50, 70)]
    wide = spark.createDataFrame([(key, i, i) for key, i in chain + same], "key long, id long, comp long")
    cells = nj._cells(wide).collect()
    assert sorted((r.cell, r.whole, r.id) for r in cells) == sorted([(k, 0, i) for k, i in chain] + [(50, 1, i) for i in range(50, 70)])
