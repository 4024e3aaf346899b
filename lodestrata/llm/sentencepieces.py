r"""Byte-pair pieces of a SentencePiece model: encoding by vectorised merge rounds, and decoding.

The library is only asked for the model's pieces, scores and settings; merges run here, on all words of a chunk of texts at once.
A text is normalised as the model says (a blank in front, blanks written as U+2581) and cut wherever no piece of the model
holds the two characters beside the cut, so no merge can cross it. What lies between cuts is a word; equal words of a chunk
are merged once. Symbols of all words lie in one flat array. In each round every pair of neighbours gets the rank of the piece that
it would make, each word's smallest rank is found by a segmented minimum, its leftmost pairs of that rank are merged at
once, and the array is compacted; words in which no pair is left are done. Of pairs that would overlap, the left one is
merged. Where a piece could be continued at a rank that isn't larger, or shares its rank, only the leftmost pair of the word
is merged in a round, as then the next merge may lie at its side. So merges come in the library's order.

A word of more than LONG symbols (a text without any cut) would take a round for almost every rank in it; it is merged with a
heap of its pairs, in the same order.

Texts are encoded in the scan's partitions and not exchanged; texts longer than PIECE characters are encoded a part at a time.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows each keep a row; an empty table
gives no rows; characters that are no pieces are written as bytes, or as the unknown piece if the model has no bytes;
controls and other special strings in a text are plain text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lodestrata.llm import shared

BLANK = "▁"
#: Characters that are encoded at a time, about, and symbols of a word from which on it is merged with a heap.
PIECE, LONG = 1_000_000, 512
NEVER = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, merges and settings of a byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        settings = {k: dict(_fields(v)) for k, v in _fields(library.serialized_model_proto()) if k in (2, 3)}
        trainer, normal = settings.get(2, {}), settings.get(3, {})
        # Field numbers of the model's format (kind of model, character map, blanks before, removed, escaped).
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("a byte-pair model with texts as they are is wanted")
        self.prefix = BLANK if normal.get(3, 1) else ""
        n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_unknown(i) or library.is_control(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not merged")
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.unknown = library.unk_id()
        self.has_bytes = any(map(library.is_byte, range(n)))
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Characters that only occur inside of pieces are symbols beyond the pieces; those in no piece are below 0, by their code.
        self.inner = inner = sorted({c for p in ids for c in p} - {p for p in ids if len(p) == 1})
        symbols = ids | {c: n + i for i, c in enumerate(inner)}
        self.pieces, self.width = n, n + len(inner)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        bigrams = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        joined = {c: i + 1 for i, c in enumerate(sorted({c for b in bigrams for c in b}))}  # 0: characters in no longer piece
        self.place = np.zeros(0x110000, np.int32)
        for c, i in joined.items():
            self.place[ord(c)] = i
        self.joins = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for b in bigrams:
            self.joins[joined[b[0]], joined[b[1]]] = True
        self.bigrams = bigrams
        # Ranks: equal scores share one. A rank is alone if no piece that continues one of its pieces has a rank as small.
        longer = [p for p in ids if len(p) > 1]
        scores = sorted({library.get_score(ids[p]) for p in longer}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = np.full(self.width, NEVER, np.int64)
        for p in longer:
            self.rank[ids[p]] = order[library.get_score(ids[p])]
        alone = np.ones(len(scores) + 1, bool)
        seen: dict[int, int] = {}
        pairs = []
        for p in longer:
            made = ids[p]
            if seen.setdefault(int(self.rank[made]), made) != made:
                alone[self.rank[made]] = False
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is None or b is None:
                    continue
                pairs.append((a * self.width + b, made))
                for part in (a, b):
                    if self.rank[made] <= self.rank[part] < NEVER:
                        alone[self.rank[part]] = False
        self.alone = alone
        pairs.sort()
        self.keys, self.made = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        self.by_pair = dict(pairs)
        texts = [b"" if special[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.byte_ids):
            if self.has_bytes:
                texts[i] = bytes([b])
        texts[self.unknown] = " ⁇ ".encode() if 44 not in trainer else trainer[44]
        self.is_byte = np.zeros(n, bool)
        if self.has_bytes:
            self.is_byte[self.byte_ids] = True
        self.text_first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.blank_first = np.array([p.startswith(BLANK) and not special[i] for i, p in enumerate(names)])
        self.silent = np.array([library.is_control(i) for i in range(n)])

    def bare(self, symbol: int) -> np.ndarray:
        """The ids of a character that is no piece."""
        c = chr(-1 - symbol) if symbol < 0 else self.inner[symbol - self.pieces]
        return self.byte_ids[list(c.encode())] if self.has_bytes else np.array([self.unknown], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that left and right make, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1).astype(np.int32)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _by_heap(m: Model, symbols: list[int]) -> list[int]:
    """The symbols of one word after all merges, smallest rank and leftmost first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            made = m.by_pair.get(symbols[i] * m.width + symbols[after[i]])
            if made is not None:
                heapq.heappush(heap, (int(m.rank[made]), i, symbols[i], symbols[after[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if symbols[i] == left else n
        if j >= n or symbols[j] != right:
            continue  # one of the two was merged since
        symbols[i], symbols[j], after[i] = m.by_pair[left * m.width + right], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def merged(m: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, and the first of each word (and the end); first: the words' first symbols before (and the end)."""
    words = len(first) - 1
    sizes = np.diff(first)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # word, symbol; in order within a word
    long = np.flatnonzero(sizes > LONG)
    for w in long:
        left = np.array(_by_heap(m, symbols[first[w] : first[w + 1]].tolist()), np.int32)
        done.append((np.full(len(left), w), left))
    word = np.repeat(np.arange(words), sizes)
    if len(long):
        keep = ~np.isin(word, long)
        word, symbols = word[keep], symbols[keep]
    made = np.full(len(symbols), -1, np.int32)
    fresh = np.ones(len(symbols), bool)  # whether the pair that starts here has to be looked up
    while len(symbols):
        last = np.r_[word[1:] != word[:-1], True]
        look = np.flatnonzero(fresh & ~last)
        made[last] = -1
        made[look] = m.pair(symbols[look], symbols[look + 1])
        rank = np.where(made >= 0, m.rank[made], NEVER)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, starts)
        size = np.diff(np.r_[starts, len(word)])
        over = np.repeat(least == NEVER, size)
        if over.any():  # words that are done leave the array
            done.append((word[over], symbols[over]))
            word, symbols, made, rank = word[~over], symbols[~over], made[~over], rank[~over]
            size, least = size[least < NEVER], least[least < NEVER]
            if not len(symbols):
                break
        own = np.repeat(least, size)
        at = np.flatnonzero(rank == own)
        new_word = np.r_[True, word[at][1:] != word[at][:-1]]
        # Of neighbouring pairs every other one is merged, from the left; or only a word's leftmost.
        run = new_word | np.r_[True, at[1:] != at[:-1] + 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        chosen = at[np.where(m.alone[own[at]], (np.arange(len(at)) - begin) % 2 == 0, new_word)]
        symbols[chosen] = made[chosen]
        gone = np.zeros(len(symbols), bool)
        gone[chosen + 1] = True
        fresh = np.zeros(len(symbols), bool)
        fresh[chosen] = True
        fresh[np.maximum(chosen - 1, 0)] = True
        before = chosen[chosen > 1] - 2  # the left neighbour may have been merged away just now
        fresh[before] = True
        keep = ~gone
        word, symbols, made, fresh = word[keep], symbols[keep], made[keep], fresh[keep]
    if not done:
        return symbols, np.zeros(words + 1, np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbols[order], np.searchsorted(word[order], np.arange(words + 1))


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] times, for each i."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - count), count)


def _encode_part(m: Model, text: str, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of normalised texts that lie end to end, and the first of each (and the end); texts: their first characters."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = m.place[chars]
    cut = np.r_[True, ~m.joins[place[:-1], place[1:]]]
    cut[texts] = True
    first = np.flatnonzero(cut)
    end = np.r_[first[1:], len(chars)]
    symbols = m.symbol[chars]
    longer = np.flatnonzero(end - first > 1)
    count = np.ones(len(first), np.int64)
    if len(longer):
        a, b = first[longer], end[longer]
        _, one, which = np.unique(shared.hashed(chars, a, b), return_index=True, return_inverse=True)
        # A hash only proposes: words whose characters differ from those of the hash's first word are merged on their own.
        size = b - a
        same = np.flatnonzero(size == size[one[which]])
        differ = chars[_places(a[same], size[same])] != chars[_places(a[one[which[same]]], size[same])]
        alike = np.zeros(len(longer), bool)
        alike[same] = ~np.logical_or.reduceat(differ, np.r_[0, np.cumsum(size[same])[:-1]])
        other = np.flatnonzero(~alike)
        which[other] = len(one) + np.arange(len(other))
        one = np.r_[one, other]
        flat, begin = merged(m, symbols[_places(a[one], size[one])], np.r_[0, np.cumsum(size[one])])
        count[longer] = np.diff(begin)[which]
    start = np.r_[0, np.cumsum(count)]
    out = np.empty(start[-1], np.int32)
    single = np.ones(len(first), bool)
    if len(longer):
        single[longer] = False
        out[_places(start[longer], count[longer])] = flat[_places(begin[which], count[longer])]
    out[start[:-1][single]] = symbols[first[single]]
    at = np.r_[start[np.searchsorted(first, texts)], start[-1]]
    bare = np.flatnonzero((out < 0) | (out >= m.pieces))
    if not len(bare):
        return out, at
    # What is no piece is one character, which becomes its bytes.
    data = [m.bare(x) for x in out[bare].tolist()]
    size = np.ones(len(out), np.int64)
    size[bare] = list(map(len, data))
    to = np.r_[0, np.cumsum(size)]
    full = np.empty(to[-1], np.int32)
    normal = np.ones(len(out), bool)
    normal[bare] = False
    full[to[:-1][normal]] = out[normal]
    full[_places(to[bare], size[bare])] = np.concatenate(data)
    return full, to[at]


def encode(m: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the first of each (and the end)."""
    normal = [m.prefix + t.replace(" ", BLANK) if t else "" for t in texts]
    parts: list[tuple[int, str]] = []  # text, and it or a part of it
    for i, text in enumerate(normal):
        at = 0
        while at < len(text):
            upto = min(at + PIECE, len(text))
            while upto < len(text) and text[upto - 1 : upto + 1] in m.bigrams:
                upto += 1
            parts.append((i, text[at:upto]))
            at = upto
    ids, counts, k = [], np.zeros(len(normal), np.int64), 0
    while k < len(parts):
        n, held = k + 1, len(parts[k][1])
        while n < len(parts) and held + len(parts[n][1]) <= PIECE:
            held += len(parts[n][1])
            n += 1
        size = [len(t) for _, t in parts[k:n]]
        found, first = _encode_part(m, "".join(t for _, t in parts[k:n]), np.r_[0, np.cumsum(size)[:-1]])
        ids.append(found)
        np.add.at(counts, [i for i, _ in parts[k:n]], np.diff(first))
        k = n
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.r_[0, np.cumsum(counts)]


def _whole(data: bytes) -> str:
    """Bytes as text, each byte that is no part of a character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        size = next((n for n in (1, 2, 3, 4) if _is_char(data[at : at + n], n)), 0)
        out.append(data[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_char(data: bytes, size: int) -> bool:
    try:
        return len(data) == size and len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def decode(m: Model, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The texts of ids that lie end to end; first: the first id of each text (and the end)."""
    size = m.text_first[ids + 1] - m.text_first[ids]
    if m.prefix and len(ids):
        begin = first[:-1][np.diff(first) > 0]
        quiet = np.flatnonzero(m.silent[ids[begin]])
        for k in quiet:  # controls in front say nothing and leave the first blank to what follows
            end = first[np.searchsorted(first, begin[k], "right")]
            while begin[k] < end - 1 and m.silent[ids[begin[k]]]:
                begin[k] += 1
        cut = begin[m.blank_first[ids[begin]]]
    else:
        cut = np.zeros(0, np.int64)
    start = m.text_first[ids].copy()
    start[cut] += 1  # the blank that encoding put in front
    size[cut] -= 1
    data = m.text_bytes[_places(start, size)].tobytes()
    at = np.r_[0, np.cumsum(size)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        piece = data[at[a] : at[b]]
        try:
            out.append(piece.decode())
        except UnicodeDecodeError:  # ids of bytes that make no character: each run of such ids is read on its own
            border = np.flatnonzero(np.diff(m.is_byte[ids[a:b]])) + 1
            parts = np.r_[a, a + border, b]
            out.append("".join(_whole(data[at[x] : at[y]]) for x, y in zip(parts[:-1], parts[1:], strict=True)))
    return out


def encode_pieces(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """keep columns and ids (array<int>) of every row of docs."""
    rows = docs.select(text, *keep)
    schema = StructType(rows.schema.fields[1:]).add("ids", ArrayType(IntegerType()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, _, _ in shared.chunks(batches, 0, PIECE):
            ids, first = encode(m, batch.column(0).to_pylist())
            found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], schema.names)

    return rows.mapInArrow(of, schema)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of encoded and text, what its ids say (null: empty)."""
    schema = StructType([*encoded.schema.fields]).add("text", StringType())
    place = encoded.columns.index(ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists = part.column(place)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.r_[0, np.cumsum([0 if n is None else n for n in lists.value_lengths().to_pylist()])].astype(np.int64)
                texts = decode(m, flat, first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(of, schema)
