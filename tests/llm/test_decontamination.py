import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=13):
    w, covered, hit = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1) if x else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    covered.update(range(i, i + n))
                    hit.add(str(item))
    return len(w), len(covered), sorted(hit)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 13, 14, 40])))) for i in range(12)] + [(90, None), (91, "..."), (None, "v1 v2")]
    docs = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            x = (items[rng.randrange(12)][1] or "").split()
            a = rng.randrange(len(x))
            parts += [" ".join(x[a:]).upper(), " ".join(word() for _ in range(rng.randrange(20)))]
        docs.append((i, ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 500])
def test_hits_equal_brute_force(spark, documents, monkeypatch, block_bytes):
    docs, items = planted(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    full = dc.verbatim_matches
    monkeypatch.setattr(dc, "verbatim_matches", lambda d, b, w: full(d, b, w, block_bytes))
    rows = dc.contamination(documents(docs + docs[:7]), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows}
    known = [x for x in items if x[0] is not None]
    assert got == {i: brute(t, known) for i, t in docs}
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs + docs[:7])  # repeated rows each keep a row


@pytest.mark.parametrize("window", [13, 30])
def test_long_windows_and_long_items(spark, documents, window):
    rng = random.Random(window)
    item = [f"i{k}" for k in range(500)]
    starts = [rng.randrange(500 - 2 * window) for _ in range(50)]
    docs = [(k, " ".join([f"a{k}", *item[a : a + window + k], f"b{k}"])) for k, a in enumerate(starts)] + [(99, " ".join(item[: window - 1]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "other words")], "item_id long, text string")
    spans = []
    for block_bytes in (dc.BLOCK_BYTES, 1600):  # the second one cuts the item into pieces of a hundred bytes
        found = {r.doc_id: [(s.start, s.length, s.item, s.item_start) for s in r.spans] for r in dc.verbatim_matches(documents(docs), bench, window, block_bytes).collect()}
        assert all(found[k] == [(1, min(window + k, 500 - a), "1", a)] for k, a in enumerate(starts)) and found[99] == []
        spans.append(found)
    assert spans[0] == spans[1]


@pytest.mark.parametrize("depth", [13, 30])
def test_suffix_array_is_sorted(depth):
    h = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint64)
    left = 300 - np.arange(300)
    order, _ = dc.suffix_array(h, left, depth)
    suffixes = [tuple(h[i : i + depth]) for i in order]
    assert suffixes == sorted(suffixes)


def test_removal_and_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    found = dc.contamination(odd.withColumn("item", odd.lang), bench).collect()
    assert len(found) == 11
    assert {r.doc_id for r in found if r.contaminated} == {4, 5}
    left = dc.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == 8
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(odd, none).count() == 11
    assert dc.contamination(odd.limit(0), bench).collect() == []


def found(texts, items, window=13):
    """Rows of one shard, as dictionaries."""
    bench = dc.Benchmark([str(i) for i, _ in items], [t for _, t in items], window)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int64())], ["d", "t", "r"])
    return [r for b in dc._spans(type("Sent", (), {"value": bench}))(iter([rows])) for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_of_repeated_words(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice("ab" if seed % 2 else "aaaaaab") for _ in range(n))
    items = [(i, some(rng.choice([1, 3, 8, 20, 60]))) for i in range(5)]
    texts = [some(rng.randrange(80)) for _ in range(6)] + [""]
    for text, row in zip(texts, found(texts, items, 6), strict=True):
        w, best = words(text), {}
        for _, t in items:
            x = words(t)
            for i in range(len(w)):
                for k in range(len(x)):
                    n = next((n for n in range(min(len(w) - i, len(x) - k)) if w[i + n] != x[k + n]), min(len(w) - i, len(x) - k))
                    if n >= min(6, len(x)):
                        best[i] = max(best.get(i, 0), n)
        assert [(s["start"], s["length"]) for s in row["spans"]] == [(i, n) for i, n in sorted(best.items()) if best.get(i - 1) != n + 1]
        for s in row["spans"]:
            assert words(items[int(s["item"])][1])[s["item_start"] :][: s["length"]] == w[s["start"] :][: s["length"]]
        hit = {k for h in row["hits"] for k in range(h["start"], h["start"] + h["length"])}
        assert (len(w), len(hit), sorted(set(row["items"]))) == brute(text, items, 6)


def test_long_repetition_takes_no_pairs():
    began = time.perf_counter()
    (row,) = found(["Word " * 20_000], [(1, "word " * 4000), (2, "word " * 3000 + "end")])
    assert row["hits"] == [{"start": 0, "length": 20_000}] and row["items"] == ["1", "2"]
    assert max(s["length"] for s in row["spans"]) == 4000
    assert time.perf_counter() - began < 20
