r"""Benchmark decontamination with suffix arrays over the training documents.

Each scan partition is cut into shards of whole documents, and each shard gets a suffix array over its words: suffixes are
ordered by as many words as the longest window has, through prefix doubling of word hashes (suffixes that agree beyond
stay together).
The suffixes of all benchmark items are looked up in it by binary search, all at once, equal first words as one: such a window
is 13 consecutive words of an item (a shorter item is one window), and the range of the array that begins with it lists its
places. A place has one window of 13 words at most, and one of each smaller length, so the places are no more than the shard's
words times 13, however often words repeat. Each place's longest match is found among its neighbours in the benchmark's own
suffix array, whose lengths in common come from hashes of prefixes, not word by word. Spans are the maximal ones of these
matches, each with one place in the benchmark where it is found; items come from the windows that occur.

Scale. Documents are never exchanged: a document lies in one shard, so its hits are complete there. The benchmark is
sent to the executors in blocks of about BLOCK_BYTES of text; a larger benchmark takes more passes over the documents,
whose hits are then merged per document. There, long items are cut into pieces that overlap by all but one word of a window,
so every window lies in one piece, and spans that go on in the same item from piece to piece are put together again.

Defined results: null or empty texts, or texts without words, have no words and no hits; benchmark items without words
match nothing; a null item_id is ignored; repeated rows of documents are judged alike and each keeps a row; a very long text
is one shard of its own, also if it repeats a few words; empty tables give no rows or no hits; other columns are ignored. Words
are compared by 64-bit hashes; the lengths of matches beyond a window by 62-bit hashes of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shared
from lodestrata.llm.shared import NOT_ALNUM

#: Text of the benchmark that is sent to the executors at a time, about; of a larger benchmark, a piece of an item has a 16th.
BLOCK_BYTES = 16_000_000
#: Text of a shard of documents, about; larger shards cost fewer searches and more memory.
SHARD_BYTES = 1_000_000

SPANS = "doc_id long, row binary, n_words long, hits array<struct<start:long,length:long>>, items array<string>, spans array<struct<start:long,length:long,item:string,item_start:long,item_row:long>>"
PIECES = "item_id string, item_row long, skipped long, text string"


#: Moduli and base of the hashes of prefixes.
_MODULI, _BASE = (2147483647, 2147483629), 1000003


class Prefixes:
    """Hashes of all prefixes of a sequence of word hashes, to compare stretches of two sequences."""

    powers = [np.ones(1, np.int64)] * 2

    def __init__(self, h: np.ndarray):
        self.sums = []
        for k, p in enumerate(_MODULI):
            power = Prefixes.powers[k]
            while len(power) <= len(h):  # doubles: base ** (i + n) = base ** i * base ** n
                power = np.r_[power, power * (int(power[-1]) * _BASE % p) % p]
            Prefixes.powers[k] = power
            terms = (h % np.uint64(p)).astype(np.int64) * power[: len(h)] % p
            self.sums.append(np.r_[0, np.cumsum(terms) % p])

    def same(self, i: np.ndarray, other: Prefixes, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i on are those of other from j on."""
        out = np.ones(len(i), bool)
        for k, p in enumerate(_MODULI):
            a, b = (self.sums[k][i + n] - self.sums[k][i]) % p, (other.sums[k][j + n] - other.sums[k][j]) % p
            low = np.minimum(i, j)
            out &= a * Prefixes.powers[k][j - low] % p == b * Prefixes.powers[k][i - low] % p
        return out

    def common(self, i: np.ndarray, other: Prefixes, j: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and j on are the same, known to be between least and most."""
        low, high = least.copy(), most.copy()
        while (busy := low < high).any():
            x = np.flatnonzero(busy)
            n = (low[x] + high[x] + 1) // 2
            yes = self.same(i[x], other, j[x], n)
            low[x] = np.where(yes, n, low[x])
            high[x] = np.where(yes, high[x], n - 1)
        return low


class Benchmark:
    """The words of a block of items or pieces, end to end, and the first word of each.

    rows: the hash of an item's whole text, which tells apart items of one id; skipped: its words before the piece.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int, rows: list[int] | None = None, skipped: list[int] | None = None):
        self.rows, self.skipped = (np.array(x if x is not None else [0] * len(ids), np.int64) for x in (rows, skipped))
        data = [(t or "").encode() for t in texts]
        raw = shared.LOWER[np.frombuffer(b"".join(data), np.uint8)]
        offsets = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
        starts, ends, self.first = shared.words(raw, offsets, NOT_ALNUM)
        self.hashes, self.ids = shared.hashed(raw, starts, ends), ids
        size = np.diff(self.first)
        self.item = np.repeat(np.arange(len(ids)), size)
        self.left = self.first[1:][self.item] - np.arange(len(self.hashes))  # words of the suffix
        need = np.minimum(window, size[self.item])  # words that a match must have
        order, _ = suffix_array(self.hashes, self.left, int(size.max(initial=0)))
        self.queries = order[self.left[order] >= need[order]]  # suffixes that hold a whole window, in order
        # Suffixes that begin with the same window are neighbours: they are looked up as one.
        q, n = self.queries, need[self.queries]
        new = np.ones(len(q), bool)
        if len(q):
            new[1:] = n[1:] != n[:-1]
            for k in range(int(n.max())):
                open_ = np.flatnonzero(~new[1:] & (n[1:] > k)) + 1
                new[open_] = self.hashes[q[open_] + k] != self.hashes[q[open_ - 1] + k]
        self.begin = np.r_[np.flatnonzero(new), len(q)]  # of the windows' ranges of queries
        self.window, self.need = q[self.begin[:-1]], n[self.begin[:-1]]
        # The ids, in order of their strings, of the items of each window.
        self.names, number = np.unique(np.array(ids, object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, int))
        pair = np.unique((np.cumsum(new) - 1) * max(1, len(self.names)) + number[self.item[q]])
        self.window_names = pair % max(1, len(self.names))
        self.names_begin = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(self.begin)))

    @cached_property
    def prefixes(self) -> Prefixes:
        return Prefixes(self.hashes)


def suffix_array(h: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of word hashes h in order of their first `depth` words or more, none beyond its document; and the word ranks.

    left: words of each suffix. Each step sorts pairs of ranks and so doubles the number of words that count.
    """
    values, rank = np.unique(h, return_inverse=True)
    rank = rank.astype(np.uint64) + np.uint64(1)  # 0: past the document's end
    order, n = np.argsort(rank, kind="stable"), len(h)
    step = 1  # words that count so far
    while step < depth and n:
        second = np.zeros(n, np.uint64)
        second[: n - step] = rank[step:]
        second[left <= step] = 0
        key = (rank << np.uint64(32)) | second
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.uint64)
        new[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]]).astype(np.uint64)
        if new.max() == n:
            break  # all suffixes differ
        rank, step = new, 2 * step
    return order, values


def _compare(h, left, order, at, bench, q, need) -> np.ndarray:
    """-1, 0, 1: how the suffixes order[at] compare with the first `need` words of the benchmark's suffixes q."""
    out, open_ = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in range(int(need.max(initial=0))):
        open_ = open_[need[open_] > k]
        if not len(open_):
            break
        s = order[at[open_]]
        there = left[s] > k
        x = np.where(there, h[np.minimum(s + k, len(h) - 1)], 0)
        y = bench.hashes[q[open_] + k]
        c = np.where(~there | (x < y), -1, np.where(x > y, 1, 0)).astype(np.int8)
        out[open_] = c
        open_ = open_[c == 0]
    return out


def places(h: np.ndarray, left: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(word, window): every place where a window of the benchmark occurs."""
    order, values = suffix_array(h, left, int(bench.need.max(initial=1)))
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = bench.hashes[bench.window]
    w = np.flatnonzero(values[np.minimum(np.searchsorted(values, first), len(values) - 1)] == first)
    edge = []
    for upper in (False, True):  # the range of suffixes that begin with the window
        low, high = np.zeros(len(w), np.int64), np.full(len(w), len(order))
        while (busy := low < high).any():
            i = np.flatnonzero(busy)
            middle = (low[i] + high[i]) // 2
            c = _compare(h, left, order, middle, bench, bench.window[w[i]], bench.need[w[i]])
            right = c <= 0 if upper else c < 0
            low[i] = np.where(right, middle + 1, low[i])
            high[i] = np.where(right, high[i], middle)
        edge.append(low)
    times = edge[1] - edge[0]
    end = np.cumsum(times)
    at = order[np.arange(end[-1] if len(end) else 0) + np.repeat(edge[0] - (end - times), times)]
    return at, np.repeat(w, times)


def longest(h: np.ndarray, left: np.ndarray, at: np.ndarray, window: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, length, benchmark suffix) of the longest match of each place, where it isn't the end of the one a word before.

    A place's longest match is with a neighbour of its own suffix in the order of the benchmark's suffixes, within its window's.
    """
    if not len(at):
        return at, at, at
    prefixes = Prefixes(h)
    low, high = bench.begin[window].copy(), bench.begin[window + 1].copy()  # where the place's suffix would stand
    need, most = bench.need[window], left[at]

    def common(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
        q = bench.queries[rank]
        return prefixes.common(at[x], bench.prefixes, q, need[x], np.minimum(most[x], bench.left[q]))

    while (busy := low < high).any():
        x = np.flatnonzero(busy)
        middle = (low[x] + high[x]) // 2
        q, n = bench.queries[middle], common(x, middle)
        ours, theirs = n < most[x], n < bench.left[q]
        mine = h[np.minimum(at[x] + n, len(h) - 1)]
        other = bench.hashes[np.minimum(q + n, len(bench.hashes) - 1)]
        before = np.where(ours & theirs, other < mine, ours)  # whether the benchmark's suffix comes before; one that ends does
        low[x] = np.where(before, middle + 1, low[x])
        high[x] = np.where(before, high[x], middle)
    length, suffix = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for rank in (low - 1, low):
        x = np.flatnonzero((rank >= bench.begin[window]) & (rank < bench.begin[window + 1]))
        n = common(x, rank[x])
        better = n > length[x]
        length[x[better]], suffix[x[better]] = n[better], bench.queries[rank[x[better]]]
    # Of the windows of a place the longest match counts.
    order = np.lexsort((-length, at))
    at, length, suffix = at[order], length[order], suffix[order]
    keep = np.r_[True, at[1:] != at[:-1]]
    at, length, suffix = at[keep], length[keep], suffix[keep]
    tail = np.zeros(len(at), bool)
    tail[1:] = (at[1:] == at[:-1] + 1) & (length[:-1] == length[1:] + 1)
    return at[~tail], length[~tail], suffix[~tail]


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values, sorted by their list `of`, in n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _spans(shared_benchmark):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared_benchmark.value
        for batch, raw, offsets in shared.chunks(batches, most=SHARD_BYTES):
            low = shared.LOWER[raw]
            starts, ends, first = shared.words(low, offsets, NOT_ALNUM)
            h, size = shared.hashed(low, starts, ends), np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            left = first[1:][doc] - np.arange(len(h))
            at, window = places(h, left, bench)
            # Words of windows, in runs that end with the document.
            open_ = np.zeros(len(h) + 1, np.int64)
            np.add.at(open_, at, 1)
            np.add.at(open_, at + bench.need[window], -1)
            hit = np.cumsum(open_)[:-1] > 0
            border = np.zeros(len(h) + 1, bool)
            border[first] = True
            run = np.flatnonzero(hit & (border[:-1] | ~np.r_[False, hit[:-1]])) if len(h) else np.zeros(0, np.int64)
            stop = np.flatnonzero(hit & (border[1:] | ~np.r_[hit[1:], False])) + 1 if len(h) else run
            hits = pa.StructArray.from_arrays([pa.array(run - first[doc[run]], pa.int64()), pa.array(stop - run, pa.int64())], ["start", "length"])
            seen = np.unique(doc[at] * len(bench.need) + window)  # a document's windows, once each
            of_doc, w = seen // max(1, len(bench.need)), seen % max(1, len(bench.need))
            times = bench.names_begin[w + 1] - bench.names_begin[w]
            end = np.cumsum(times)
            name = bench.window_names[np.arange(end[-1] if len(end) else 0) + np.repeat(bench.names_begin[w] - (end - times), times)]
            known = np.unique(np.repeat(of_doc, times) * max(1, len(bench.names)) + name)
            names = pa.array(bench.names[known % max(1, len(bench.names))], pa.string())
            at, length, suffix = longest(h, left, at, window, bench)
            item = bench.item[suffix]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(at - first[doc[at]], pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([bench.ids[i] for i in item], pa.string()),
                    pa.array(suffix - bench.first[item] + bench.skipped[item], pa.int64()),
                    pa.array(bench.rows[item], pa.int64()),
                ],
                ["start", "length", "item", "item_start", "item_row"],
            )
            n = len(size)
            lists = [_lists(doc[run], n, hits), _lists(known // max(1, len(bench.names)), n, names), _lists(doc[at], n, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), *lists], ["doc_id", "row", "n_words", "hits", "items", "spans"])

    return of


def _cut(window: int, size: int):
    """Cuts texts longer than `size` bytes into pieces that overlap by window - 1 words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item_id, item_row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                if len(data) <= size:
                    rows.append((item_id, item_row, 0, text))
                    continue
                raw = shared.LOWER[np.frombuffer(data, np.uint8)]
                starts, ends, _ = shared.words(raw, np.array([0, len(raw)]), NOT_ALNUM)
                at = 0
                while True:
                    upto = max(int(np.searchsorted(ends, starts[at] + size, "right")), at + 1) if len(starts) else 0
                    last = min(upto + window - 1, len(starts))  # windows that start before `upto` end here
                    if last:
                        rows.append((item_id, item_row, at, data[starts[at] : ends[last - 1]].decode()))
                    if last >= len(starts):
                        break
                    at = upto
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "item_row", "skipped", "text"])

    return of


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts together a document's spans that run on in the same text of an item."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64()), ("item_row", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            kept: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["item"], s["item_row"], s["start"] - s["item_start"], s["start"])):
                last = kept[-1] if kept else None
                same = last and all(s[k] == last[k] for k in ("item", "item_row")) and s["start"] - s["item_start"] == last["start"] - last["item_start"]
                if same and s["start"] <= last["start"] + last["length"]:
                    last["length"] = max(last["length"], s["start"] + s["length"] - last["start"])
                else:
                    kept.append(s)
            out.append(kept)
        names = ["doc_id", "row", "n_words", "hits", "items"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, kind)], [*names, "spans"])


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row, n_words, hits, items, spans of every row of docs (row is the MD5 of its text).

    hits: stretches of words in windows (those of several blocks may overlap); items: those whose windows occur; spans: the
    longest verbatim matches (word start, length, item, its word, hash of its text), none the end of another.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.xxhash64("text").alias("item_row"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        items = items.withColumn("skipped", F.lit(0))
    else:
        items = shared.stored(items.mapInArrow(_cut(window, max(1, block_bytes // 16)), PIECES), "items")
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("row"))  # rows are told apart by their content
    passes = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_row", "skipped"), F.lit(blocks)) == k).orderBy("item_id", "item_row", "skipped").collect()
        block = Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows], window, [r["item_row"] for r in rows], [r["skipped"] for r in rows])
        passes.append(texts.mapInArrow(_spans(spark.sparkContext.broadcast(block)), SPANS))
    if blocks == 1:
        return passes[0]
    union = passes[0].withColumn("pass", F.lit(0))
    for k, p in enumerate(passes[1:], 1):
        union = union.unionByName(p.withColumn("pass", F.lit(k)))
    # Equal rows have equal spans in a pass: they count as one with a number of times, and are that many rows at the end.
    lists = ("hits", "items", "spans")
    once = union.groupBy("doc_id", "row", "n_words", "pass").agg(*[F.first(c).alias(c) for c in lists], F.count("*").alias("times"))
    merged = once.groupBy("doc_id", "row", "n_words").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists], F.min("times").alias("times"))
    each = merged.select("doc_id", "row", "n_words", *lists, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).drop("time")
    return each.mapInArrow(_joined, SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """As judged, without row."""
    return judged(docs, benchmark, window, share).drop("row")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, row, n_words, n_hit, items (sorted), contaminated, spans: n_hit words lie in windows; share * n_hit >= n_words contaminates."""
    found = verbatim_matches(docs, benchmark, window)
    # Stretches sorted by start: a word counts once, from the farthest end so far.
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["length"] - F.greatest(s["end"], x["start"]))).alias("n"),
        F.greatest(s["end"], x["start"] + x["length"]).alias("end"),
    )
    zero = F.lit(0).cast("long")
    covered = F.aggregate(F.sort_array("hits"), F.struct(zero.alias("n"), zero.alias("end")), step, lambda s: s["n"])
    return found.select(
        "doc_id",
        "row",
        "n_words",
        covered.alias("n_hit"),
        F.sort_array(F.array_distinct("items")).alias("items"),
        "spans",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows, which are few; rows are told by id and text, so others of the same or no id stay."""
    bad = judged(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    bad = shared.small(shared.stored(bad, "contaminated"))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & text_key(docs["text"]).eqNullSafe(bad["bad_row"])
    return docs.join(bad, same, "left_anti")
