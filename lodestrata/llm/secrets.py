r"""Secret scan with multipart credential linking.

Per document a scan finds base findings (kinds assign, access, hex) and weak parts: identifiers (`id`), opaque tokens
(`token`) and `endpoint`s. A weak part alone proves nothing. An interval join links it with complementary parts in its
scope: an identifier or an endpoint counts with a secret in it, a token with an identifier or an endpoint in it. Only
linked weak parts are reported; base findings always stay.

A part's scope is its block of lines (blocks are parted by blank lines), and of that what lies at most REACH code points
from the part. Parts that complete others are whole: hexadecimal numbers without a letter complete none, addresses have
four octets, and a token that lies in an identifier or endpoint is a piece of it and no part.

The join is one pass over a block's parts in order of place: for each part the end of the last and the start of the
next complementary part are running values of a window, so no pair is ever made, however many parts a block has.

Spans. Places are code points, end exclusive, of the whole match. Weak parts that overlap a base finding are that finding
and are not reported again.

Defined results: null text is empty, empty text has no findings; repeated rows each keep a row; a null doc_id is kept; a
very long text is scanned whole; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import shared

#: How far, in code points, complementary parts may be apart.
REACH = 300
KINDS = ("assign", "access", "hex", "id", "token", "endpoint")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Weak parts: identifiers that are named, or mail addresses; endpoints by URL or address; tokens of letters and digits.
ID = re.compile(r"""(?:client|account|tenant|user|access|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.ASCII | re.IGNORECASE)
MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
ADDRESS = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\x09-\x0D\x20\"'<>]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
_DIGIT = re.compile(r"[0-9]")

#: kind: the kinds that complete it.
COMPLEMENTS = {
    "id": ("assign", "hex", "token"),
    "endpoint": ("assign", "access", "hex", "token"),
    "token": ("access", "id", "endpoint"),
}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base findings and weak parts, by place and then kind as listed in KINDS."""
    base, weak, tokens = [], [], []
    digits = _DIGIT.search(text)
    if "=" in text or ":" in text:
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
        weak += [(m.start(), m.end(), "id") for m in ID.finditer(text)]
    if "@" in text:
        weak += [(m.start(), m.end(), "id") for m in MAIL.finditer(text)]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if digits:
        weak += [(m.start(), m.end(), "endpoint") for m in DOTTED.finditer(text) if ADDRESS.fullmatch(m[0])]
        tokens += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if _mixed(m[0])]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    kept = base + _beside(weak, base) + _beside(tokens, base + weak)
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2])))


def _mixed(token: str) -> bool:
    return any(map(str.isalpha, token)) and any(map(str.isdigit, token))


def _beside(parts: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of parts that overlap none of others."""
    others = sorted(others)
    starts, reach = [x[0] for x in others], list(itertools.accumulate((x[1] for x in others), max))
    return [x for x in parts if not _overlaps(x, starts, reach)]


def _overlaps(x: tuple[int, int, str], starts: list[int], reach: list[int]) -> bool:
    """Whether any base finding that starts before x ends reaches beyond x's start."""
    i = bisect_left(starts, x[1])
    return i > 0 and reach[i - 1] > x[0]


PARTS = "doc_id long, row long, parts array<struct<start:long,end:long,kind:string,block:long,completes:boolean>>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("completes", pa.bool_())]
    for batch, _, _ in shared.chunks(batches):
        found = []
        for text in batch.column(1).to_pylist():
            parts = scan(text) if text else []
            breaks = [m.start() for m in BLANK_LINE.finditer(text)] if len(parts) > 1 else []
            rows = [(a, b, kind, bisect_left(breaks, a), kind != "hex" or not text[a:b].isdigit()) for a, b, kind in parts]
            found.append([dict(zip(("start", "end", "kind", "block", "completes"), x, strict=True)) for x in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.struct(fields)))], ["doc_id", "row", "parts"])


def linked_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, spans array<struct<start,at,end,kind>> of docs (doc_id, text): base findings and linked weak parts by place."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_parts, PARTS)
    # Equal rows have equal parts: they are linked once and are as many rows again at the end.
    once = rows.groupBy("doc_id", "row").agg(F.first("parts").alias("parts"), F.count("*").alias("times"))
    parts = once.select("doc_id", "row", "times", F.explode_outer("parts").alias("part")).select("doc_id", "row", "times", "part.*")
    ahead = Window.partitionBy("doc_id", "row", "block").orderBy("start", "end", "kind")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    after = ahead.rowsBetween(1, Window.unboundedFollowing)
    near: Column = F.lit(False)
    for weak, kinds in COMPLEMENTS.items():
        is_other = F.col("kind").isin(*kinds) & F.col("completes")
        last_end = F.max(F.when(is_other, F.col("end"))).over(before)
        next_start = F.min(F.when(is_other, F.col("start"))).over(after)
        close = F.coalesce(F.col("start") - last_end <= reach, F.lit(False)) | F.coalesce(next_start - F.col("end") <= reach, F.lit(False))
        near = near | ((F.col("kind") == weak) & close)
    kept = parts.withColumn("kept", F.col("kind").isin(*BASE) | near)
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("start", at.alias("at"), "end", "kind")))))
    linked = kept.groupBy("doc_id", "row").agg(spans.alias("spans"), F.min("times").alias("times"))
    return linked.select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).drop("time")


def digest(spans: str | Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
