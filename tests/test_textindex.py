"""The index against scans of the texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import search, textindex
from lodestrata.sources import versions


def test_numbers_as_bytes():
    rng = np.random.default_rng(1)
    values = np.r_[0, 1, 127, 128, 2**14 - 1, 2**14, 2**62, rng.integers(0, 2**40, 500), rng.integers(0, 200, 500)]
    data, at = textindex.pack(values)
    assert textindex.unpack(data).tolist() == values.tolist() and at[-1] == len(data)
    assert textindex.unpack(data[: at[3]]).tolist() == [0, 1, 127]
    assert textindex.unpack(textindex.pack(np.zeros(0, np.int64))[0]).tolist() == []


def rounded(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def assert_same(spark, path, now):
    docs = spark.createDataFrame(sorted(now.items()), "id long, t string")
    for query in (["cache", "cafe"], ["cache", ("cache", "cache"), ("of", "the", "cache")], [("nowhere", "here")]):
        assert rounded(textindex.bm25(spark, path, query)) == rounded(search.bm25(docs, "id", "t", query))
    for phrase in (["the", "cache"], ["cache", "of", "cache"]):
        assert {r.doc_id for r in textindex.phrase(spark, path, phrase).collect()} == {r.doc_id for r in search.phrase_match(docs, "id", "t", phrase).collect()}


def test_updates_merges_and_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FANOUT", 3)
    monkeypatch.setattr(textindex, "BLOCK_TOKENS", 40)
    path, rng, now = f"file://{tmp_path}/index", random.Random(4), {}
    text = lambda: rng.choice([None, "", " ".join(rng.choice(["cache", "the", "of", "Café", "rules"]) for _ in range(rng.randrange(30)))])
    seen = []
    for step in range(6):
        changed = {i: text() for i in rng.sample(range(-5, 40), 12)}
        removed = set(rng.sample(range(40), 4)) - set(changed)
        now = {i: t for i, t in now.items() if i not in removed} | changed
        rows = spark.createDataFrame(list(changed.items()) + [(None, "cache")], "id long, t string")
        number = textindex.update(spark, path, rows, spark.createDataFrame([(i,) for i in removed], "id long"), "id", "t")
        assert number == step + 1
        seen.append(dict(now))
    said = versions.newest(spark, path)[1]
    assert said["docs"] == len(now) and len(said["segments"]) < 6 and max(s["level"] for s in said["segments"]) >= 1
    assert_same(spark, path, now)
    docs = spark.createDataFrame(sorted(seen[1].items()), "id long, t string")  # a reader of an older version goes on
    assert rounded(textindex.bm25(spark, path, ["cache"], version=2)) == rounded(search.bm25(docs, "id", "t", ["cache"]))


def test_an_update_writes_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.range(3000).selectExpr("id", "concat('some words of text number ', id, ' ', repeat('and more ', 20)) as t")
    textindex.update(spark, path, docs, None, "id", "t")
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before = size()
    textindex.update(spark, path, docs.where("id < 3").selectExpr("id", "'new' as t"), None, "id", "t")
    assert size() - before < before / 10
    assert {r.doc_id for r in textindex.bm25(spark, path, ["new"]).collect()} == {0, 1, 2}
    assert textindex.hits(spark, path, ["words"])[0].count() == 2997


def test_of_two_updates_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "cache")], "id long, t string")
    textindex.update(spark, path, one, None, "id", "t")
    stale = versions.newest(spark, path)
    textindex.update(spark, path, one, None, "id", "t")
    monkeypatch.setattr(versions, "newest", lambda *a: stale)
    with pytest.raises(versions.Conflict):
        textindex.update(spark, path, one, None, "id", "t")
    monkeypatch.undo()
    assert versions.newest(spark, path)[0] == 2
    unfinished = tmp_path / "index/_versions/000000000003.json"
    unfinished.write_text('{"seg')
    assert versions.newest(spark, path)[0] == 2  # readers don't see it, writers stop
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 2, {})


def test_empty_and_kept_indexes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert textindex.bm25(spark, path, ["cache"]).collect() == []
    none = spark.createDataFrame([], "id long, t string")
    textindex.update(spark, path, none, none, "id", "t")
    assert textindex.bm25(spark, path, ["cache"]).collect() == []
    spark.createDataFrame([(1, "cache")], "id long, t string").write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    first = textindex.index_of(docs, "id", "t")
    assert textindex.index_of(docs, "id", "t") == first and versions.newest(spark, first)[0] == 1
    spark.createDataFrame([(1, "other")], "id long, t string").write.mode("overwrite").parquet(f"file://{tmp_path}/docs")
    assert textindex.index_of(spark.read.parquet(f"file://{tmp_path}/docs"), "id", "t") != first


def test_blocks_are_decoded_some_at_a_time(monkeypatch):
    texts = pa.table({"doc_id": range(200), "t": [["a", "b", "a"]] * 200}).to_batches(max_chunksize=10)
    blocks = pa.Table.from_batches(textindex._blocks(iter(texts))).combine_chunks().to_batches()
    assert len(blocks) == 1
    whole = {p: pa.Table.from_batches(textindex._decoded(p)(iter(blocks))) for p in (False, True)}
    monkeypatch.setattr(textindex, "DECODED", 30)
    for places, expected in whole.items():
        parts = list(textindex._decoded(places)(iter(blocks)))
        assert pa.Table.from_batches(parts).to_pylist() == expected.to_pylist()
        assert len(parts) > 8 and max(map(len, parts)) <= 40
