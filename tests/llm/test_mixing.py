import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Shares by weight, capped; the excess is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in done]
        if not free:
            return done
        rest = total - sum(done.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, "d": 7, None: 400}, {"a": 5}, {"a": 1, "b": 1, "c": 100_000}, {"a": 0, "b": 9}])
def test_targets(spark, sizes):
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_taken_follows_targets(documents):
    rows = [(i, f"w{i} " * (1 + i % 50), "en", f"s{min(i % 7, 3)}") for i in range(600)]
    docs = documents(rows)
    got = mixing.mix_sources(docs, block=64).withColumn("key", F.col("target"))
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert len(per) == 4 and all(abs(r.taken - r.target) <= 1 and r["size"] == r.source_size for r in per)
    assert got.where("taken > 3 * size").isEmpty()
    again = mixing.mix_sources(docs.repartition(5), block=64)
    key = ["doc_id", "size", "taken", "first_slot"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def xxhash64(*values):
    """Spark's hash of columns: each with the hash so far as its seed; nulls leave it."""
    h = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, h)
    return h - 2**64 if h >= 2**63 else h


def plain_mix(rows, block, goal=None):
    """(doc_id, size, taken, first_slot) by plain loops over (doc_id, text, source); goal: the sources' targets, if given."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in sources}
    goal = goal or water_fill({s: sum(size[i] for i in own[s]) for s in sources})
    total, slots = sum(size.values()), -(-sum(size.values()) // block)
    high, at = {}, 0.0
    for s in (s for s in sources if goal[s] > 0):
        at += goal[s]
        high[s] = at / sum(x for x in goal.values() if x > 0)
    slot_of = {s: [] for s in sources}
    for j in range(slots):
        u = (j + 1) * mixing.PHI % 1
        s = next((s for s in high if u < high[s]), ())
        if s != ():
            slot_of[s].append(j)
    out, bins = [], math.isqrt(len(rows)) + 1
    for s in sources:
        total = sum(size[i] for i in own[s])
        key = {}
        for i in own[s]:
            text_hash = xxhash64(rows[i][1])
            mixed = xxhash64(struct.pack("<i", 17), rows[i][0], text_hash)
            key[i] = (((mixed % 2**64) >> 34) * bins // (1 << 30), mixed, rows[i][0] is not None, rows[i][0] or 0, text_hash, size[i])
        offset = 0
        for i in sorted(own[s], key=key.get):
            taken, first = 0, None
            begin = offset
            while size[i] and begin < int(goal[s]):
                end = min(begin + size[i], int(goal[s]))
                taken += end - begin
                for rank in range(begin // block, (end - 1) // block + 1):
                    slot = slot_of[s][rank] if rank < len(slot_of[s]) else slots
                    first = slot if first is None else min(first, slot)
                begin += total
            out.append((rows[i][0], size[i], taken, first))
            offset += size[i]
    return out


@pytest.mark.parametrize("block", [16, 64])
def test_mix_equals_plain_loops(documents, block):
    rows = [(i if i % 9 else None, f"w{i} " * (i * 7 % 40), "en", [None, "s0", "s1", "s2"][min(i % 7, 3)]) for i in range(400)] + [(5, "same", "en", "s0")] * 3 + [(6, None, "en", "s9")]
    got = mixing.mix_sources(documents(rows), block=block).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    expected = plain_mix([(r[0], r[1], r[3]) for r in rows], block)
    assert sorted(((r.doc_id, r["size"], r.taken, r.first_slot) for r in got), key=key) == sorted(expected, key=key)


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(1, 500.0), (2, 300.0), (3, 200.0)], "src long, target double")
    slots = mixing.schedule(goals, 1000).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1000))
    for k in (10, 100, 1000):
        for src, share in ((1, 0.5), (2, 0.3), (3, 0.2)):
            assert abs(sum(r.src == src for r in slots[:k]) - k * share) < 4
    ranks = [r.rank for r in slots if r.src == 1]
    assert ranks == list(range(len(ranks)))


def test_odd_rows(odd, documents):
    got = mixing.mix_sources(odd.withColumn("size", F.lit(1)).withColumn("src", F.lit("x"))).collect()
    assert len(got) == 11 and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix_sources(documents([])).collect() == []
    assert [r.taken for r in mixing.mix_sources(documents([(1, ""), (2, None)])).collect()] == [0, 0]
