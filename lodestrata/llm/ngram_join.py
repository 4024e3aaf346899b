r"""N-gram Jaccard join by parity sketches: every pair of documents whose shingle sets have Jaccard >= num/den, exactly.

Method. A document's set holds 64-bit hashes of its distinct word n-grams. Documents with equal sets form a class, and
classes are joined. In a size band (powers of two), each shingle of a class flips one bit of a parity sketch; a shingle
that only one of two sets has changes at most one bit, so the Hamming distance of two sketches is at most the size of
the symmetric difference. Jaccard >= t bounds that difference by d = (1-t)/(1+t) * (|A|+|B|). The sketch is cut into
segments, more than d, so two linked classes agree on all but d of them (pigeonhole). Each class offers only d + 1
segments, those with most bits set first: under one order for all, two lists that share all but d members share one
among their first d + 1. In this sketch each of the 2**64 hashes has a bit of its own, so segments agree by shared
shingles and not by chance, whose agreements would grow with the square of the input. Segments that agree make buckets.
Distances are taken between sketches folded to 2 to 4 bits a member.

Pairs. A bucket never yields all its pairs. First each member is compared with the bucket's smallest member; what proves
linked is joined into components. Buckets that still hold several components are looked at again: for some rounds, each
member is compared with one member of another component, and components grow together. A round is given only the buckets that the
one before left with several components; those of two members are compared from the start. What is then left apart is looked at
in full, so the rounds decide nothing but how little that is, and no link between components is lost. In a bucket of
few members, the pairs of different components are joined, with the sketches' bound in the condition, which makes some
rows a member; their sets are then read and compared exactly. Pairs of larger buckets never become rows, as those within
the bound may still grow with the square of a group of near copies: the members' sets are dealt to tiles of bounded
size, in which numpy compares wide sketches and then sets, and of which only links that join two components come back,
fewer than the tile has members. Large buckets that share most of their members are dealt as one.

Scale. Texts are read in the scan's partitions and never exchanged (unless more classes than a broadcast bound are
repeated); what moves is about 0.2 (key, id) rows a shingle, and the keys' counts. Counts and bucket minima are aggregated before
the exchange, and joins on bucket keys can be split by AQE, so one bucket may hold any share of the rows.

Defined results: null and empty texts, or texts without words, have an empty set, n_shingles 0, and link with nothing;
a text of fewer than n words has its whole sequence as its one shingle; repeated rows of one doc_id count as one
document each with their own set, all with that id; ties go to the smaller id; a null doc_id is not linked and keeps
component_id null; an empty table gives no rows; other columns are dropped. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shared
from lodestrata.llm.components import components
from lodestrata.llm.shared import SPACE, stored

#: Rounds in which members are compared with one member of another component, before components are compared in full.
ROUNDS = 5
#: Members of different components up to which a bucket's pairs are joined: at most half as many rows a member.
FEW = 16
#: Bytes of sets, and sets, of a block; a task compares two blocks at a time.
BLOCK_BYTES, BLOCK_SETS = 8_000_000, 8192


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes (lower-cased A-Z, words between ASCII white space)."""
    low = shared.LOWER[raw]
    starts, ends, per_text = shared.words(low, offsets, SPACE)
    h = shared.hashed(low, starts, ends)
    grams = np.zeros(0, np.uint64)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            grams = shared.mix(grams + h[k : len(h) - n + 1 + k])
    for i in range(len(offsets) - 1):
        a, b = per_text[i], per_text[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = shared.mix(whole + h[k])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def most_differences(total: int, num: int, den: int) -> int:
    """The largest symmetric difference that two sets of `total` members together may have."""
    return total * (den - num) // (den + num)


def offered(sets: np.ndarray, num: int, den: int) -> np.ndarray:
    """The bucket keys of one set (sorted distinct 64-bit hashes), in its own band and, if partners may be there, the next."""
    n = len(sets)
    own, partner = n.bit_length() - 1, n * den // num
    keys = []
    for band in range(own, partner.bit_length()):
        top = 2 ** (band + 1) - 1
        d = most_differences(n + min(partner, top), num, den)
        if band == own and d == 0:
            continue  # equal sets only, and those are one class
        segments = -(-5 * (most_differences(2 * top, num, den) + 1) // 4)
        segment = (sets >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)  # sorted, as sets are
        cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        salt = np.uint64(band << 56)
        key = np.bitwise_xor.reduceat(shared.mix(sets ^ salt), cut)
        bits = np.diff(np.r_[cut, n])
        order = np.lexsort((key, -bits))[: d + 1]
        keys.append(shared.mix(key[order] + salt + np.uint64(1)))
        if len(cut) <= d:  # too few segments have bits: empty ones count as well, by the same order
            empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), segment[cut])
            keys.append(np.sort(shared.mix(empty ^ salt ^ np.uint64(1 << 55)))[: d + 1 - len(cut)])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def folded_sketch(sets: np.ndarray, bits: int = 0) -> np.ndarray:
    """A parity sketch of 64-bit words, 2 to 4 bits a member if not given; halving it by XOR gives that of the band below."""
    bits = max(64, bits or 2 ** (len(sets).bit_length() + 1))
    at = sets & np.uint64(bits - 1)
    on = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").view(np.uint64)


def forest(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b) by which all linked sets of different sides (of a lone side: all linked sets) come into one component.

    They start from comps, and each joins two components, so they are fewer than sets.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[k] for k in order]
    sizes, root, links = np.array([len(s) for s in sets]), np.unique(comps[order], return_inverse=True)[1], []
    lone = (sides == sides[0]).all()
    for band in sorted({int(n).bit_length() for n in sizes}):
        first, end, last = np.searchsorted(sizes, [2 ** (band - 1), 2**band, (2**band - 1) * den // num + 1])
        sketches = np.stack([folded_sketch(s, 2 ** (band + 3)) for s in sets[first:last]])
        for i in range(first, end):
            j = np.arange(i + 1, np.searchsorted(sizes, sizes[i] * den // num, "right"))
            j = j[(root[j] != root[i]) & (lone | (sides[j] != sides[i]))]
            apart = np.bitwise_count(sketches[j - first] ^ sketches[i - first]).sum(1, dtype=np.int64)
            j = j[apart <= (sizes[i] + sizes[j]) * (den - num) // (den + num)]
            while len(j):
                k, both = j[0], len(np.intersect1d(sets[i], sets[j[0]], assume_unique=True))
                j = j[1:]
                if den * both >= num * (sizes[i] + sizes[k] - both):
                    links.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    root[root == root[k]] = root[i]
                    j = j[root[j] != root[i]]
    return links


def _classes(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shared.chunks(batches):
            sizes, keys = [], []
            for s in shingle_sets(raw, offsets, n):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n", "set_key"])

    return of


def _sketches(n: int, num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shared.chunks(batches):
            ids, sizes, keys, sketches = [], [], [], []
            for i, s in enumerate(shingle_sets(raw, offsets, n)):
                if len(s) and len(k := offered(s, num, den)):
                    ids.append(i)
                    sizes.append(len(s))
                    keys.append(k.view(np.int64))
                    sketches.append(folded_sketch(s).view(np.int64))
            lists = [
                pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in xs])].astype(np.int32), np.concatenate(xs) if xs else np.zeros(0, np.int64))
                for xs in (keys, sketches)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["id", "n", "keys", "sketch"])

    return of


def _sets(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shared.chunks(batches):
            data = [s.tobytes() for s in shingle_sets(raw, offsets, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.large_binary()).cast(pa.binary())], ["id", "members"])

    return of


def _linked(num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared_members = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared_members >= num * (len(x) + len(y) - shared_members))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return of


def _forests(num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _runs(batches, ["cell", "whole", "x", "y"]):
            ids, comps, sides = (tile.column(c).to_numpy() for c in ("id", "comp", "block"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("members")]
            links = np.array(forest(ids, comps, sides, sets, num, den), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return of


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of equal numbers `by`, which come one after another, together."""
    held, of = [], None
    for batch in batches:
        at = np.column_stack([batch.column(c).to_numpy() for c in by])
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and (at[i] != of).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            of = at[i]
    if held:
        yield pa.Table.from_batches(held)


def _hamming(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def _fold(s: Column) -> Column:
    half = (F.size(s) / 2).cast("int")
    return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _close(num: int, den: int) -> Column:
    """Whether sizes n_a, n_b and the Hamming distance of sketches s_a, s_b allow the similarity."""
    size_a, size_b = F.size("s_a"), F.size("s_b")
    x = F.when(size_a > size_b, _fold(F.col("s_a"))).otherwise(F.col("s_a"))
    y = F.when(size_b > size_a, _fold(F.col("s_b"))).otherwise(F.col("s_b"))
    most = F.floor((F.col("n_a") + F.col("n_b")) * (den - num) / (den + num))
    return (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (_hamming(x, y) <= most)


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id of buckets with comp, the component of id so far."""
    return buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) that are linked, by the Hamming bound and then by their sets."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if ids.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS:
        sketches = sketches.join(F.broadcast(ids), "id", "left_semi")  # so that only sketches of these are exchanged
    p = pairs.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b")
    close = stored(p.where(_close(num, den)).select("a", "b"), "close")
    needed = shared.small(close.select(F.col("a").alias("id")).union(close.select("b")).distinct())
    sets = stored(texts.join(needed, "id", "left_semi").mapInArrow(_sets(n), "id long, members binary"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"members_{x}"))
    return stored(close.join(side("a"), "a").join(side("b"), "b").mapInArrow(_linked(num, den), "a long, b long"), "linked")


def _cells(wide: DataFrame) -> DataFrame:
    """Distinct (cell, whole, id, comp) of wide (key, id, comp): what is compared together.

    Buckets that are joined by members make a group. It is one cell if it has no more pairs than its buckets have one by
    one, as those of near copies do; else each bucket is a cell.
    """
    hubs = wide.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").cast("double").alias("of"))
    groups = components(wide.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    keys = stored(hubs.join(groups.select(F.col("node").alias("hub"), F.col("comp").alias("group")), "hub"), "keys")
    of = groups.groupBy(F.col("comp").alias("group")).agg(F.count("*").cast("double").alias("members"))
    of = keys.groupBy("group").agg(F.sum(F.col("of") * F.col("of")).alias("pairs")).join(of, "group")
    whole = of.select("group", (F.col("members") * F.col("members") <= F.col("pairs")).cast("long").alias("whole"))
    cell = F.when(F.col("whole") == 1, F.col("group")).otherwise(F.col("key")).alias("cell")
    return wide.join(keys.join(whole, "group").select("key", cell, "whole"), "key").select("cell", "whole", "id", "comp").distinct()


def _joined(wide: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components comp of linked members of the buckets wide (key, id, comp), as forests of tiles."""
    cells = stored(_cells(wide), "cells")
    ids = shared.small(cells.select("id").distinct())
    sets = stored(texts.join(ids, "id", "left_semi").mapInArrow(_sets(n), "id long, members binary").distinct(), "wide_sets")
    sizes = cells.join(sets.select("id", F.length("members").alias("bytes")), "id").groupBy("cell", "whole").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("of"))
    blocks = F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("of") / BLOCK_SETS)).alias("blocks")
    rows = cells.join(sets, "id").join(sizes.select("cell", "whole", blocks), ["cell", "whole"])
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(id, members), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tile = [F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]
    tiles = rows.select("cell", "whole", *tile, "block", "id", "comp", "members")
    tiles = tiles.repartition("cell", "whole", "x", "y").sortWithinPartitions("cell", "whole", "x", "y")
    return stored(tiles.mapInArrow(_forests(num, den), "a long, b long"), "joined")


def ngram_jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): links where den * |A & B| >= num * |A | B|."""
    texts = docs.select("doc_id", "text")
    classes = stored(texts.mapInArrow(_classes(n), "doc_id long, n long, set_key binary"), "classes")
    reps = classes.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = stored(reps, "reps")  # so that the join reads two plain exchanges, and AQE can split the one with many copies
    member = stored(classes.join(reps, "set_key", "left").select("doc_id", "n", "rep"), "members")
    stands = F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False))
    repeated = shared.small(member.groupBy("doc_id").agg(F.bool_or(stands).alias("stands")).where("not stands").select("doc_id"))
    firsts = texts.where("doc_id is not null").join(repeated, "doc_id", "left_anti").withColumnRenamed("doc_id", "id")
    sketches = stored(firsts.mapInArrow(_sketches(n, num, den), "id long, n long, keys array<long>, sketch array<long>"), "sketches")

    rows = sketches.select("id", F.explode("keys").alias("key"))
    # Most keys are met once. They go by their count alone, as ids beside keys would double what is exchanged.
    met = stored(rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key"), "met")
    hubs = met.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("of")).where("hub < last")
    buckets = stored(met.join(hubs.select("key", "hub", "of"), "key"), "buckets")
    stars = stored(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = _verified(stars, sketches, firsts, n, num, den)
    labels = components(links)

    # Buckets in which several components are left: first, for some rounds, each member is compared with one member of another
    # component, by which groups of near copies grow together without their pairs being listed. Components only grow, so a
    # bucket that has become one of them is done; the two members of a smaller one were compared as a star.
    compared, apart = stars, buckets.where("of > 2").select("key", "id")
    for _ in range(ROUNDS):
        labelled = _labelled(apart, labels)
        at = F.struct("comp", "id")
        ends = labelled.groupBy("key").agg(F.min(at).alias("x"), F.max(at).alias("y")).where("x.comp < y.comp")
        other = F.when(F.col("comp") == F.col("x.comp"), F.col("y.id")).otherwise(F.col("x.id"))
        apart = stored(labelled.join(ends, "key").select("key", "id", other.alias("other")), "apart")
        pairs = apart.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = stored(pairs.join(compared, ["a", "b"], "left_anti"), "round")
        if pairs.isEmpty():
            break
        compared = compared.unionByName(pairs)
        found = _verified(pairs, sketches, firsts, n, num, den)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        labels = components(links)

    # Then the members of components that are still apart and were not compared yet.
    labelled = _labelled(apart.select("key", "id"), labels)
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("of")).where("x < y")
    left = stored(labelled.join(open_keys.select("key", "of"), "key").select("key", "id", "comp", "of"), "open")
    # One row for each key of a member, so they carry half of the sketch.
    half = F.when(F.size("sketch") > 1, _fold(F.col("sketch"))).otherwise(F.col("sketch")).alias("sketch")
    few = stored(left.where(F.col("of") <= FEW).join(sketches.select("id", "n", half), "id"), "few")
    a, b = _side(few, "a", "key", "comp"), _side(few, "b", "key", "comp")
    unlike = (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
    more = a.join(b, unlike & _close(num, den)).select("a", "b").distinct()
    more = stored(more.join(compared, ["a", "b"], "left_anti"), "more")
    last = [] if more.isEmpty() else [_verified(more, sketches, firsts, n, num, den)]
    wide = left.where(F.col("of") > FEW).select("key", "id", "comp")
    if not wide.isEmpty():
        last.append(_joined(wide, firsts, n, num, den))
    if last:
        labels = components(reduce(DataFrame.unionByName, last, links))
    named = labels.select(F.col("node").alias("rep"), "comp")
    return member.join(named, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id")
    )
