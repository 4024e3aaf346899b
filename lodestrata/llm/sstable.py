"""Token ids in sorted-string-table shards: one file per key range, searchable by document without reading it whole.

File: data blocks, block index, Bloom filter, footer.
- A key is 13 bytes: 0 for a null doc_id or else 1, the doc_id as a big-endian number with its sign bit flipped, and the
  occurrence (0, 1, ...) among the file's rows of one doc_id; byte order is therefore key order, null first.
- A block holds entries up to BLOCK_BYTES: varint of the bytes shared with the key before, varint of the rest's length,
  varint of the value's length, the rest of the key, the value (ids as little-endian unsigned numbers of `width` bytes).
  Blocks are compressed with zstd.
- The index has for each block its first key, place, length and the number of ids in the file before it.
- The Bloom filter has 10 bits a key and 7 probes.
- The footer has fixed size and names the places of index and filter, the counts and the width.

Writing. Documents are range-partitioned and sorted by doc_id, and where an id (or null) is repeated by the text's beginning, its hash
and the scan's partition, so that rows of one id may fill any number of files, which the list has in order; each task tokenizes its rows in order and streams one
file, under a name that no other attempt uses, to the shared folder. The list of files is the tasks' own result, written
by Spark's committer, so files of lost or repeated attempts are never listed.

Defined results: null and empty text give the end id alone; rows of one doc_id are kept as occurrences, in order of the first
32 characters and then of a hash of their texts;
an empty table gives no file and no rows; a text of any length is one value, read and written whole; other columns are
dropped. The string of an added token inside a text is that token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import chunks, mix, shared_dir, stored

BLOCK_BYTES = 1 << 18
#: Texts are encoded in pieces of about this size.
PIECE_BYTES = 1_000_000
#: Slots of the table of short pre-tokens, and the bytes and the ids that a slot has room for.
SLOT_BITS, SHORT, ROOM = 20, 16, 8
#: Entries of the cache of other pre-tokens, and the longest that it keeps.
LONG_CACHE, LONG = 50_000, 200
MAGIC = b"LDSST001"
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, length, filter at, length, documents, ids, width, magic
ENTRY = struct.Struct("<13sQIQ")  # first key, block at, length, ids before
MANIFEST = "path string, first_id long, last_id long, first_key binary, docs long, ids long, first_head string, first_hash long, first_part int"

#: Kinds of bytes: white space, letters, digits, other printable ones, and those that only the whole tokenizer judges. The
#: letters beyond ASCII are U+00C0 to U+00FF, whose first byte in UTF-8 is C3 (but for the signs C3 97 and C3 B7).
_BLANK, _LETTER, _DIGIT, _MARK, _UNKNOWN = range(5)
_KIND = np.full(256, _UNKNOWN, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
#: What may follow an apostrophe as an ending of its own.
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
#: A single space between printable ASCII: a place where a long text may be cut, as a pre-token starts there.
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: How byte-level models show bytes: printable ones of Latin-1 as they are, the others from U+0100 on, in order.
_AS_IS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHER = [b for b in range(0x100) if b not in _AS_IS]
_SHOWN = "".join(chr(b if b in _AS_IS else 0x100 + _OTHER.index(b)) for b in range(0x100))
#: The first n bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def pre_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start, and which of them are unjudged: whole stretches for the tokenizer itself.

    raw: texts end to end, cut at offsets. As in byte-level models, a run of letters, of digits or of other marks is one
    pre-token, with one space before it; the rest of a run of white space is another; an apostrophe and an ending such
    as `'s` are one. Bytes of other kinds are judged by the tokenizer together with all up to the next sure starts.
    """
    n = len(raw)
    kind = _KIND[raw]
    sign = (raw[1:] == 0x97) | (raw[1:] == 0xB7)
    signs = np.flatnonzero((raw[:-1] == 0xC3) & sign)
    kind[signs] = kind[signs + 1] = _UNKNOWN
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first, last = first[:-1], first[1:]
    blank, before = kind == _BLANK, np.r_[np.uint8(_BLANK), kind[:-1]]
    after_blank = (before == _BLANK) & ~first
    after_space = np.r_[False, raw[:-1] == 0x20] & ~first
    full_next = ~np.r_[blank[1:], True] & ~last  # a byte that is no white space follows in the same text
    start = first | np.where(blank, ~after_blank | full_next, np.where(after_blank, ~after_space, kind != before))
    sure = first | ((raw == 0x20) & full_next & ~after_blank & (before != _UNKNOWN) & (np.r_[kind[1:], np.uint8(_UNKNOWN)] != _UNKNOWN))
    for p in np.flatnonzero((raw == 0x27) & start & full_next):
        text_end = int(offsets[np.searchsorted(offsets, p, "right")])
        for ending in _ENDINGS:
            end = p + 1 + len(ending)
            if end <= text_end and raw[p + 1 : end].tobytes() == ending:
                start[p + 1 : end] = False
                if end < text_end and kind[end] == _LETTER:
                    start[end] = True
                break
    unjudged = np.zeros(0, np.int64)
    unknown = np.flatnonzero(kind == _UNKNOWN)
    if len(unknown):
        places = np.r_[np.flatnonzero(sure), n]
        group = np.unique(np.searchsorted(places, unknown, "right") - 1)
        unjudged = places[group]
        inside = np.zeros(n + 1, np.int8)
        inside[unjudged] += 1
        inside[places[group + 1]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        start[inside] = False
        start[unjudged] = True
    return np.flatnonzero(start), unjudged


class Encoder:
    """Texts to ids with the library's model, each different pre-token once as long as the caches keep it.

    Pre-tokens of byte-level models are found in bulk, and those of up to SHORT bytes with up to ROOM ids are kept in a table
    of 2 ** SLOT_BITS slots, in which a newer one takes its slot from an older one: memory is fixed. Texts with an added
    token, and all texts of other kinds of tokenizers, go through the whole tokenizer.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.model, self.long = self.tokenizer.model, {}
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        pre = made.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.byte_level = not made.get("normalizer") and plain == {k: pre.get(k, True) for k in plain} and (made["model"].get("type") == "BPE")
        self.added = [t["content"].encode() for t in made.get("added_tokens", [])]
        slots = 1 << SLOT_BITS
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)  # a pre-token's bytes; never all 0
        self.size, self.ids = np.zeros(slots, np.uint8), np.zeros((slots, ROOM), self.kind)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each of the texts that lie in raw (UTF-8 bytes) from offset to offset, as little-endian bytes."""
        data = raw.tobytes()
        plain = lambda text: self.byte_level and not any(t in text for t in self.added)
        if not plain(data):
            for a, b in itertools.pairwise(offsets.tolist()):
                if plain(data[a:b]):
                    yield from self.encode(raw[a:b], np.array([0, b - a]))
                else:
                    yield np.array(self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False).ids, self.kind).tobytes()
        elif len(offsets) == 2 and len(raw) > PIECE_BYTES:  # a long text is cut where pre-tokens start
            cuts = [0]
            while m := _CUT.search(data, cuts[-1] + PIECE_BYTES):
                cuts.append(m.start())
            pieces = (raw[a:b] for a, b in itertools.pairwise([*cuts, len(raw)]))
            yield b"".join(ids for x in pieces for ids in self._in_bulk(x, np.array([0, len(x)])))
        else:
            yield from self._in_bulk(raw, offsets)

    def _in_bulk(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        if not len(raw):
            yield from [b""] * (len(offsets) - 1)
            return
        starts, unjudged = pre_tokens(raw, offsets)
        length = np.diff(np.r_[starts, len(raw)])
        padded = np.r_[raw, np.zeros(SHORT, np.uint8)]
        words = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))  # eight bytes from each place on
        low = words[starts] & _FIRST[np.minimum(length, 8)]
        high = words[np.minimum(starts + 8, len(raw))] & _FIRST[np.clip(length - 8, 0, 8)]
        short = length <= SHORT
        short[np.searchsorted(starts, unjudged)] = False
        code = mix(low + mix(high))
        slot = (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (self.low[slot] == low) & (self.high[slot] == high) & short

        # Pre-tokens that are not in the table: the short ones by their first occurrence, others one by one. `number` is the
        # place of each in the lists of new ids.
        new = np.flatnonzero(~known)
        fits = short[new]
        _, once, number_of = np.unique(code[new[fits]], return_index=True, return_inverse=True)
        one = new[fits][once]
        equal = (low[one][number_of] == low[new[fits]]) & (high[one][number_of] == high[new[fits]])
        number = np.full(len(new), -1)
        number[fits] = np.where(equal, number_of, -1)
        rest = number < 0
        flat, sizes = self._encoded(raw, starts, length, one)
        number[rest] = self._others(raw, starts, length, new[rest], set(unjudged.tolist()), flat, sizes)
        ids, sizes = np.array(flat, self.kind), np.array(sizes, np.int64)
        first = np.cumsum(sizes) - sizes

        count = self.size[slot].astype(np.int64)
        count[new] = sizes[number]
        place = np.r_[0, np.cumsum(count)]
        out = np.empty(place[-1], self.kind)
        hit = np.flatnonzero(known)
        at, of, left = place[hit], slot[hit], count[hit]
        for k in range(ROOM):
            at, of, left = (at, of, left) if not k else (x[left > k] for x in (at, of, left))
            out[at + k] = self.ids[of, k]
        many = count[new]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(place[new], many) + step] = ids[np.repeat(first[number], many) + step]

        # The new short ones take their slots, the last one of those with the same slot.
        keep = np.flatnonzero(sizes[: len(one)] <= ROOM)
        to = slot[one[keep]]
        self.low[to], self.high[to], self.size[to] = low[one[keep]], high[one[keep]], sizes[keep]
        for k in range(ROOM):
            more = sizes[keep] > k
            self.ids[to[more], k] = ids[first[keep][more] + k]

        bounds = place[np.searchsorted(starts, offsets)] * self.kind.itemsize
        data = out.tobytes()
        yield from (data[a:b] for a, b in itertools.pairwise(bounds.tolist()))

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[list[int], list[int]]:
        """The ids of the pre-tokens `which`, end to end, and the number of each."""
        shown, flat, sizes, tokenize = codecs.charmap_decode(raw.tobytes(), "strict", _SHOWN)[0], [], [], self.model.tokenize
        for a, n in zip(starts[which].tolist(), length[which].tolist(), strict=True):
            ids = [t.id for t in tokenize(shown[a : a + n])]
            flat += ids
            sizes.append(len(ids))
        return flat, sizes

    def _others(self, raw, starts, length, which, unjudged, flat, sizes) -> list[int]:
        """Adds the ids of long or unjudged pre-tokens to flat and sizes, each different one once; gives their places."""
        data, seen, number = raw.tobytes(), {}, []
        for a, n in zip(starts[which].tolist(), length[which].tolist(), strict=True):
            piece = data[a : a + n]
            if (i := seen.get(piece)) is None:
                i = seen[piece] = len(sizes)
                if (ids := self.long.get(piece)) is None:
                    if a in unjudged:
                        ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
                    else:
                        ids = [t.id for t in self.model.tokenize(codecs.charmap_decode(piece, "strict", _SHOWN)[0])]
                    if len(self.long) >= LONG_CACHE:
                        self.long = {}
                    if n <= LONG:
                        self.long[piece] = ids
                flat += ids
                sizes.append(len(ids))
            number.append(i)
        return number


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One encoder, and so one cache, for all tasks of a worker process."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def key_of(doc_id: int | None, occurrence: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else doc_id + 2**63, occurrence)


def id_of(key: bytes) -> int | None:
    known, number, _ = struct.unpack(">BQI", key)
    return number - 2**63 if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Seven bit numbers for each key, by double hashing."""
    raw = np.frombuffer(b"".join(k.rjust(16, b"\0") for k in keys), ">u8").astype(np.uint64).reshape(-1, 2)
    h = mix(raw[:, 0] * np.uint64(0x9E3779B97F4A7C15) + raw[:, 1])
    step = mix(h + np.uint64(1)) | np.uint64(1)
    return (h[:, None] + np.arange(7, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.ids, self.docs = out, width, 0, 0, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self) -> None:
        self.block, self.size, self.last, self.first, self.before = [], 0, b"", b"", self.ids

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, key: bytes, value: bytes) -> None:
        same = 0
        if self.block:
            same = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=True)) if x != y), len(key))
        else:
            self.first = key
        rest = key[same:]
        entry = b"".join((_varint(same), _varint(len(rest)), _varint(len(value)), rest, value))
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        self.docs += 1
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            at = self.at
            self.index.append(ENTRY.pack(self.first, at, self._put(self.zip.compress(b"".join(self.block))), self.before))
            self._new()

    def close(self) -> None:
        self.flush()
        index_at, index_size = self.at, self._put(b"".join(self.index))
        bits = np.zeros(-(-max(64, 10 * len(self.keys)) // 8) * 8, np.uint8)
        for i in range(0, len(self.keys), 100_000):
            bits[_probes(self.keys[i : i + 100_000], len(bits)).ravel().astype(np.int64)] = 1
        filter_at, filter_size = self.at, self._put(np.packbits(bits).tobytes())
        self._put(FOOTER.pack(index_at, index_size, filter_at, filter_size, self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """One file: `get` by doc_id with the filter and a binary search, or all entries in order."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        end = self.file.size()
        index_at, index_size, filter_at, filter_size, self.docs, self.ids, self.width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.index = list(ENTRY.iter_unpack(self._read(index_at, index_size)))
        self.filter = np.frombuffer(self._read(filter_at, filter_size), np.uint8)
        self.unzip = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, _ = self.index[i]
        data, at, key = self.unzip.decompress(self._read(at, size)), 0, b""
        while at < len(data):
            same, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:same] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        key = key_of(doc_id, occurrence)
        bit = _probes([key], 8 * len(self.filter))[0].astype(np.int64)
        if not (self.filter[bit // 8] >> (7 - bit % 8).astype(np.uint8) & 1).all():
            return None
        i = bisect.bisect_right(self.index, key, key=lambda e: e[0]) - 1
        if i >= 0:
            for k, value in self._block(i):
                if k == key:
                    return np.frombuffer(value, f"<u{self.width}")
        return None


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) into `folder`; returns the list of files, one row each (see MANIFEST)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    order = ("doc_id", "head", "hash", "part")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, width).encode, end_id.to_bytes(width, "little")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, begin = f"{uuid.uuid4().hex}.sst", None, []
        last, first_id, n = None, None, 0
        for batch, raw, offsets in chunks(batches, most=PIECE_BYTES):
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), encode(raw, offsets), strict=True):
                if out is None:
                    begin = [batch.column(c)[0].as_py() for c in ("head", "hash", "part")]
                    out, first_id = Writer(store.open_output_stream(f"{base}/{name}"), width), doc_id
                    n = -1
                    last = doc_id
                n = n + 1 if doc_id == last else 0
                last = doc_id
                out.add(key_of(doc_id, n), value + end)
        if out is not None:
            out.close()
            row = [f"{folder}/{name}", first_id, last, key_of(first_id), out.docs, out.ids, *begin]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            names = ["path", "first_id", "last_id", "first_key", "docs", "ids", "first_head", "first_hash", "first_part"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of ids as little-endian 32-bit numbers) of every document in the files."""
    before = Window.orderBy("first_key", "first_head", "first_hash", "first_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
                reader, rows = Reader(path), []
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.width}")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                reader.file.close()
                yield _rows(rows)

    files = manifest.count()
    return placed.select("path", "ids_before").repartition(max(1, files)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_shards(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the shards into the shared folder and reads them back, see read_shards."""
    return read_shards(write_shards(docs, tokenizer_path, shared_dir(docs.sparkSession, "sst")))
