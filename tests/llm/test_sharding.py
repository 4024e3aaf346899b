import zlib

from pyspark.sql import functions as F

from lodestrata.llm import sharding


def check(rows, shards):
    rows = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert ids == sorted(ids)
    for k in {r.shard for r in rows}:
        slots = [r.slot for r in rows if r.shard == k]
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards for r in rows)


def test_contiguous_and_balanced(documents):
    rows = [(i * 5 % 997, "x" * (i * 37 % 200)) for i in range(997)]
    got = sharding.balanced_shards(documents(rows)).collect()
    check(got, 8)
    texts = dict(rows)
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    total = sum(r.size for r in got)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(abs(s - total / 8) for s in sizes) <= 201


def test_odd_rows(odd, documents):
    got = sharding.balanced_shards(odd.withColumn("part", F.lit(1)).withColumn("size", F.lit("x"))).collect()
    assert len(got) == 11
    check(got, 8)
    assert sorted(r.size for r in got)[:3] == [1, 1, 1]
    assert sharding.balanced_shards(documents([])).collect() == []
    assert [r.slot for r in sharding.balanced_shards(documents([(1, "a")])).collect()] == [0]
