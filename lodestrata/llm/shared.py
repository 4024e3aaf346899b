"""What several operators share: tables in the cluster's shared folder, and fast word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.arrays import bound
from lodestrata.sources import storage
from lodestrata.sources.storage import shared_dir, stored

__all__ = ["bound", "shared_dir", "small", "stored"]

#: Bytes of text that the numpy helpers work on at a time; one longer text is worked on whole.
CHUNK_BYTES = 400_000
#: Rows of identifiers (8 bytes each) up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000


def small(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if it is counted to have at most `bound` rows, else as it is."""
    return storage.small(ids, bound)


# --- numpy over Arrow strings -------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are not in words of letters and digits: ASCII but for 0-9 and a-z (A-Z is lowered first).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, bytes, offsets) with at most `most` bytes of text or else one row; null is empty."""
    for batch in batches:
        col = batch.column(text)
        if pa.types.is_large_string(col.type):
            kind = np.int64
        else:
            kind = np.int32
        if not len(col):
            continue
        _, offs, data = col.buffers()
        offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        pa.default_memory_pool().release_unused()  # workers are reused; what a batch needed goes back


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the number of words before it (one more at the end).

    A word is a run of bytes that are no separators; it never crosses from one text into the next.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, moved to a common origin and scrambled.

    Different words share a hash with a chance of about 2**-64 for each pair that is compared.
    """
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
