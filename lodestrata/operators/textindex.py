"""A full-text index of positions, in segments, for BM25 and phrases without reading texts.

Each update writes one segment of the texts that it was given, and tombstones for the documents that changed or went; what older
segments say of these no longer counts. A version (see sources.versions) names the segments and tombstones that make it up, and
how many documents and tokens are alive, so an update writes as much as changed, readers of older versions go on, and of two
updates at once one fails. Segments have levels: FANOUT segments of one level are merged to one of the next, which leaves dead
postings out, so that a posting is written again once a level, and there are few segments to read.

A segment holds blocks of postings. A block has the postings of one term in some thousand documents, as four lists of numbers
in variable-length bytes: steps from document to document, the documents' lengths, the term's counts, and the steps from place
to place. Terms are dealt to BUCKETS folders, and sorted in their files, so a query reads its terms' row groups; places are only
read for phrases, whose documents are found by intersecting the terms' places.

Scale. Blocks are made in the scan's partitions; a frequent term has a block from each of them, so no task holds all of its
postings. Queries decode their terms' blocks in parallel. Statistics come from the version, not from a scan.

Defined results: a null text is empty; rows without doc_id are not indexed; a document given twice in one update counts twice; an
empty table gives an index without segments, in which nothing is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators.search import scored
from lodestrata.sources import versions
from lodestrata.sources.storage import small, stored

BUCKETS, FANOUT = 64, 4
#: Tokens of the documents that a block is made of, about.
BLOCK_TOKENS = 2_000_000
#: Postings or bytes of places that are decoded together, about.
DECODED = 250_000

BLOCKS = "bucket int, part int, term string, first long, n int, docs binary, lengths binary, counts binary, gaps binary"
POSTINGS = "doc_id long, term string, dl int, tf int, places array<int>"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on as bytes, seven bits each, the last byte of a number below 128; and where each begins (and the end)."""
    parts, sizes = [np.zeros(0, np.uint8)], np.ones(len(values), np.uint8)
    for i in range(0, len(values), 1 << 18):  # some at a time, which takes less memory
        some = values[i : i + (1 << 18)].astype(np.uint64)
        size = sizes[i : i + (1 << 18)]
        for k in range(1, 10):
            size += some >= np.uint64(1) << np.uint64(7 * k)
        at = np.cumsum(size, dtype=np.int64) - size
        out = np.zeros(at[-1] + size[-1], np.uint8)
        for k in range(int(size.max())):
            x = np.flatnonzero(size > k)
            more = (size[x] > k + 1).astype(np.uint8) << 7
            out[at[x] + k] = (some[x] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
        parts.append(out)
    return np.concatenate(parts), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers that pack wrote, end to end."""
    end = np.flatnonzero(data < 128)
    begin = np.r_[0, end[:-1] + 1] if len(end) else end
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - begin).max(initial=-1)) + 1):
        x = np.flatnonzero(end - begin >= k)
        out[x] |= (data[begin[x] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _encoded(doc_ids: np.ndarray, lengths: np.ndarray, terms: pa.Array, doc: np.ndarray, code: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Blocks of tokens: token i has the term terms[code[i]] at place[i] of document doc[i]; sorted by code, document, place."""
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(code)])
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    of, d = code[first], doc[first]
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    walk = np.diff(doc_ids[d], prepend=0)
    walk[begin] = 0
    end = np.r_[begin, len(first)]
    token_end = np.r_[first[begin], len(code)] if len(first) else np.zeros(1, np.int64)
    columns = []
    for values, border in ((walk, end), (lengths[d], end), (counts, end), (steps, token_end)):
        data, at = pack(values)
        columns.append(_binary(data, at[border]))
    names = terms.take(pa.array(of[begin]))
    n = len(begin)
    kinds = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, doc_ids[0] % 8 if len(doc_ids) else 0, np.int32)), names, pa.array(doc_ids[d[begin]], pa.int64()), pa.array(np.diff(end), pa.int32())]
    return pa.RecordBatch.from_arrays([*kinds, *columns], [c.split()[0] for c in BLOCKS.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, t: their tokens)."""
    for batch in batches:
        size = np.array([n or 0 for n in batch.column("t").value_lengths().to_pylist()], np.int64)
        border = np.searchsorted(np.cumsum(size), np.arange(BLOCK_TOKENS, size.sum() + BLOCK_TOKENS, BLOCK_TOKENS)) if len(size) else []
        for a, b in zip([0, *[x + 1 for x in border]], [*[x + 1 for x in border], len(batch)], strict=True):
            part = batch.slice(a, max(0, min(b, len(batch)) - a))
            if not len(part):
                continue
            part = part.take(pa.array(np.argsort(part.column("doc_id").to_numpy(), kind="stable")))
            lengths = np.array(part.column("t").value_lengths().to_pylist(), np.int64)
            found = part.column("t").flatten().dictionary_encode()
            code = found.indices.to_numpy()
            doc = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            place = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
            order = np.argsort(code, kind="stable")
            yield _encoded(part.column("doc_id").to_numpy(), lengths, found.dictionary, doc[order], code[order], place[order])


def _parts(batch: pa.RecordBatch, with_places: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, whole blocks of about DECODED numbers at a time: there may be thousands of blocks of one term."""
    size = batch.column("n").to_numpy().astype(np.int64)
    if with_places:
        size = size + pc.binary_length(batch.column("gaps")).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // DECODED
    border = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(border, [*border[1:], len(batch)], strict=False):
        yield batch.slice(a, b - a)


def _decoded(with_places: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, with_places)):
            flat = lambda c: unpack(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8))
            n = batch.column("n").to_numpy().astype(np.int64)
            begin = np.cumsum(n) - n
            walk, counts = np.cumsum(flat("docs")), flat("counts")
            docs = walk - np.repeat(walk[begin], n) + np.repeat(batch.column("first").to_numpy(), n) if len(n) else walk
            columns = [pa.array(docs, pa.int64()), batch.column("term").take(pa.array(np.repeat(np.arange(len(n)), n)))]
            columns += [pa.array(flat("lengths"), pa.int32()), pa.array(counts, pa.int32())]
            border = np.r_[0, np.cumsum(counts)]
            if with_places:
                steps = np.cumsum(flat("gaps"))
                before = np.r_[0, steps][border[:-1]]
                columns.append(pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(steps - np.repeat(before, counts), pa.int32())))
            else:
                columns.append(pa.nulls(len(docs), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "term", "dl", "tf", "places"])

    return of


def _recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that are sorted by term and document."""
    for batch in batches:
        if not len(batch):
            continue
        counts = batch.column("tf").to_numpy().astype(np.int64)
        terms = batch.column("term").dictionary_encode()
        ids, lengths = batch.column("doc_id").to_numpy(), batch.column("dl").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(batch)), counts)
        yield _encoded(ids, lengths, terms.dictionary, row, terms.indices.to_numpy()[row], batch.column("places").flatten().to_numpy().astype(np.int64))


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(blocks: DataFrame, path: str) -> None:
    dealt = blocks.withColumn("bucket", _bucket("term"))
    dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "term").drop("part").write.partitionBy("bucket").parquet(path)


def _totals(lengths: DataFrame) -> tuple[int, int]:
    row = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _alive(rows: DataFrame, spark: SparkSession, said: dict) -> DataFrame:
    """rows (doc_id, number, others) without what tombstones of later segments speak of."""
    if not said.get("tombstones"):
        return rows
    dead = spark.read.schema("gone long, below long").parquet(*said["tombstones"]).groupBy("gone").agg(F.max("below").alias("below"))
    return rows.join(small(dead), (F.col("doc_id") == F.col("gone")) & (F.col("number") < F.col("below")), "left_anti")


def _read(spark: SparkSession, segments: Sequence[dict], part: str, schema: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """A part of all segments with `number`, the segment's; only of the wanted terms."""
    out = []
    for s in segments:
        rows = spark.read.schema(schema).parquet(f"{s['path']}/{part}")
        if wanted is not None:
            rows = rows.where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in wanted]) & F.col("term").isin(*wanted))
        out.append((s["number"], rows))
    return reduce(DataFrame.unionByName, [r.withColumn("number", F.lit(n).cast("long")) for n, r in out])


def update(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None, doc_id: str, text: str) -> int:
    """Indexes the documents of changed (new or with a new text) and takes those of removed (doc_id) out; gives the new version.

    Raises versions.Conflict if another update of the version that this one began from came first.
    """
    after, said = versions.newest(spark, path)
    segments, number = list(said.get("segments", [])), said.get("number", 0) + 1
    docs = changed.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    folder = f"{path}/segments/{number}-{uuid.uuid4().hex[:12]}"
    listed = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    _write(listed.mapInArrow(_blocks, BLOCKS), f"{folder}/blocks")
    listed.select("doc_id", F.size("t").alias("dl")).write.parquet(f"{folder}/lengths")
    new = spark.read.schema("doc_id long, dl int").parquet(f"{folder}/lengths")
    n_docs, n_tokens = _totals(new)
    said = {**said, "number": number, "docs": said.get("docs", 0) + n_docs, "tokens": said.get("tokens", 0) + n_tokens}
    if segments:
        gone = new.select("doc_id")
        if removed is not None:
            gone = gone.unionByName(removed.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id")))
        gone = stored(gone.distinct(), "gone")
        old = _alive(_read(spark, segments, "lengths", "doc_id long, dl int"), spark, said)
        d, t = _totals(old.join(small(gone), "doc_id", "left_semi"))
        if d:
            marks = f"{path}/tombstones/{number}-{uuid.uuid4().hex[:12]}"
            gone.select(F.col("doc_id").alias("gone"), F.lit(number).cast("long").alias("below")).write.parquet(marks)
            said |= {"tombstones": [*said.get("tombstones", []), marks], "docs": said["docs"] - d, "tokens": said["tokens"] - t}
    if n_docs:
        segments.append({"path": folder, "number": number, "level": 0, "docs": n_docs})
    said["segments"] = segments
    while (level := next((x for x in sorted({s["level"] for s in segments}) if sum(s["level"] == x for s in segments) >= FANOUT), None)) is not None:
        segments = said["segments"] = _merged(spark, path, said, level)
    if not any(s["number"] < number for s in segments):
        said["tombstones"] = []  # all of them speak of older segments
    return versions.commit(spark, path, after, said)


def _merged(spark: SparkSession, path: str, said: dict, level: int) -> list[dict]:
    """The segments of a version with those of a level as one of the next level, without dead postings."""
    old, rest = ([s for s in said["segments"] if (s["level"] == level) == yes] for yes in (True, False))
    number = max(s["number"] for s in old)
    folder = f"{path}/segments/{number}-{uuid.uuid4().hex[:12]}"
    parts = [b.where(f"number = {s['number']}").mapInArrow(_decoded(True), POSTINGS).withColumn("number", F.lit(s["number"]).cast("long"))
             for s in old for b in [_read(spark, [s], "blocks", BLOCKS.replace("part int, ", ""))]]
    postings = _alive(reduce(DataFrame.unionByName, parts), spark, said).drop("number")
    # One term's postings are dealt by documents, so a frequent one is no single task's.
    dealt = postings.repartition(_bucket("term"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("term", "doc_id")
    _write(dealt.mapInArrow(_recoded, BLOCKS), f"{folder}/blocks")
    _alive(_read(spark, old, "lengths", "doc_id long, dl int"), spark, said).select("doc_id", "dl").write.parquet(f"{folder}/lengths")
    n, _ = _totals(spark.read.schema("doc_id long, dl int").parquet(f"{folder}/lengths"))
    merged = [{"path": folder, "number": number, "level": level + 1, "docs": n}] if n else []
    return sorted(rest + merged, key=lambda s: s["number"])


def postings(spark: SparkSession, path: str, wanted: Sequence[str], places: bool = False, version: int | None = None) -> tuple[DataFrame, dict]:
    """doc_id, term, dl, tf, places of the wanted terms in the newest or a given version, and what that version says."""
    said = versions.newest(spark, path)[1] if version is None else versions.content(spark, path, version)
    segments = (said or {}).get("segments", [])
    if not segments or not wanted:
        return spark.createDataFrame([], POSTINGS), said or {}
    schema = "bucket int, term string, first long, n int, docs binary, lengths binary, counts binary" + (", gaps binary" if places else "")
    parts = [_read(spark, [s], "blocks", schema, sorted(set(wanted))).drop("number").mapInArrow(_decoded(places), POSTINGS).withColumn("number", F.lit(s["number"]).cast("long")) for s in segments]
    return _alive(reduce(DataFrame.unionByName, parts), spark, said).drop("number"), said


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def hits(spark: SparkSession, path: str, query: Sequence[str | tuple[str, ...]], version: int | None = None) -> tuple[DataFrame, dict]:
    """doc_id, term, dl, tf of the query's terms and phrases (tuples of tokens; as term, joined by blanks), and the version."""
    wanted = sorted({(q,) if isinstance(q, str) else tuple(q) for q in query if q})
    single, longer = [p[0] for p in wanted if len(p) == 1], [p for p in wanted if len(p) > 1]
    found, said = postings(spark, path, single, version=version)
    found = found.drop("places")
    for phrase in longer:
        rows, _ = postings(spark, path, phrase, places=True, version=version)
        own = rows.groupBy("doc_id").agg(F.first("dl").alias("dl"), *[F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(phrase)])
        begins = [_moved(F.col(f"p{i}"), i) for i in range(len(phrase))]
        tf = F.size(reduce(F.array_intersect, begins))
        there = reduce(Column.__and__, [F.col(f"p{i}").isNotNull() for i in range(len(phrase))])
        found = found.unionByName(own.where(there).select("doc_id", F.lit(" ".join(phrase)).alias("term"), "dl", tf.alias("tf")).where("tf > 0"))
    return found, said


def bm25(spark: SparkSession, path: str, query: Sequence[str | tuple[str, ...]], version: int | None = None) -> DataFrame:
    """doc_id, score of the query's terms and phrases, from the index alone."""
    found, said = hits(spark, path, query, version)
    n, tokens_ = said.get("docs", 0), said.get("tokens", 0)
    return scored(found, spark.createDataFrame([(n, tokens_ / n if n else 0.0)], "n long, avgdl double"))


def phrase(spark: SparkSession, path: str, phrase: Sequence[str], version: int | None = None) -> DataFrame:
    """doc_id of the documents that hold the tokens of phrase one after another."""
    return hits(spark, path, [tuple(phrase)], version)[0].select("doc_id")


def index_of(docs: DataFrame, doc_id: str, text: str) -> str:
    """The path of an index of docs, a table read from files; built if the shared folder has none of these files as they are."""
    spark, path = docs.sparkSession, versions.beside(docs, "text-index", doc_id, text)
    if not versions.newest(spark, path)[0]:
        try:
            update(spark, path, docs, None, doc_id, text)
        except versions.Conflict:
            pass  # another session has just built it
    return path
