"""Language identification by mixture inference.

Training counts hashed byte 4-grams of words, per language, over all training rows: partial counts per partition, summed
in one exchange to BUCKETS * languages cells, which is also the size of the model that is sent to executors: a quarter of a
megabyte a language, whatever the corpus (300 languages: 79 MB).
A document's words are drawn from a mixture of languages; a word's likelihood in a language is the product of its n-grams'
probabilities, and expectation-maximisation estimates the document's proportions. The set of languages is chosen by
penalised likelihood (BIC): of the sets that the languages form in order of their share, up to all of the model's, the one
whose refitted mixture is best after half the log of the number of words is taken off for each further language; sizes that
can't be better, as even all languages together gain too little, are not fitted. Each fit runs until it has converged.
The prediction is the language with the largest share.

Defined results: null text, or text without any letter, gives `und` with score 0, as does a model without training rows;
words without letters carry no evidence; training rows with null lang or null text are left out; repeated rows are
scored alike; a very long text is scored whole; empty tables give no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from lodestrata.llm import shared

GRAM, BUCKETS = 4, 1 << 16
#: Numbers of n-grams by languages that are looked up at a time.
CELLS = 1 << 23
#: EM ends when no mixture of the allowed languages can have a log likelihood that is larger by more than this.
TOLERANCE = 0.01

#: Bytes between words: ASCII other than letters. Letters beyond ASCII are parts of words, as are other such characters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _grams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (a power of two) of all n-grams of words (with a mark before and after each word), the first of each word, words before each text."""
    starts, ends, per_text = shared.words(raw, offsets, NOT_LETTER)
    size = ends - starts
    count = np.maximum(size + 2 - GRAM + 1, 1)  # words of one letter have one n-gram, ended early
    first = np.r_[0, np.cumsum(count)].astype(np.int64)
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(starts, count) - 1
    begin, end = np.repeat(starts, count), np.repeat(ends, count)
    code = np.zeros(len(at), np.uint32)
    for k in range(GRAM):
        p = at + k
        byte = np.where((p >= begin) & (p < end), raw[np.clip(p, 0, max(len(raw) - 1, 0))], 0).astype(np.uint32) if len(raw) else code
        code = code << np.uint32(8) | byte
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    return code.astype(np.int64) & (buckets - 1), first, per_text


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Bytes and offsets of the lower-cased texts, and which of them have a letter."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    letters = [any(map(str.isalpha, t)) for t in texts]
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64), letters


def _counts(languages: list[str], buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch, _, _ in shared.chunks(batches, 0):
            raw, offsets, _ = _lowered(batch.column(0))
            code, first, per_text = _grams(raw, offsets, buckets)
            grams = np.diff(first[per_text])
            lang = np.repeat([number[x] for x in batch.column(1).to_pylist()], grams)
            total += np.bincount(lang * buckets + code, minlength=total.size).reshape(total.shape)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell // buckets, pa.int32()), pa.array(cell % buckets, pa.int32()), pa.array(total.ravel()[cell], pa.int64())], ["lang", "bucket", "n"])

    return of


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets, languages) from all rows of labelled (text, lang)."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    buckets = BUCKETS
    summed = rows.mapInArrow(_counts(languages, buckets), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((buckets, len(languages)))
    counts[summed["bucket"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
    # A language's bucket is smoothed towards the mean of all, so that rare n-grams favour none.
    mean = (counts.sum(1) + 1) / (counts.sum() + buckets)
    weight = 50.0
    return languages, np.log((counts + weight * mean[:, None] * buckets / 64) / (counts.sum(0) + weight * buckets / 64)).astype(np.float32)


def _fit(logs: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of each text over its allowed languages, and the log likelihood, both to convergence.

    logs: words' log likelihoods; first: the first word of each text (texts without words are left out). The likelihood
    is concave, so its slopes bound what is left to gain: texts go on until that is at most TOLERANCE.
    """
    size = np.diff(np.r_[first, len(logs)])
    text = np.repeat(np.arange(len(first)), size)
    p = np.where(allowed[text], logs, -np.inf)
    scale = p.max(1)
    p = np.exp(p - scale[:, None])
    theta = allowed / allowed.sum(1, keepdims=True)
    out, likelihood = theta.copy(), np.zeros(len(first))
    base = np.add.reduceat(scale, first)
    left = np.arange(len(first))  # texts that are not done
    while len(left):
        mixed = (p * theta[text]).sum(1)
        slope = np.add.reduceat(p / mixed[:, None], first)
        done = slope.max(1) - size <= TOLERANCE
        if done.any():
            out[left[done]] = theta[done]
            likelihood[left[done]] = np.add.reduceat(np.log(mixed), first)[done] + base[left[done]]
            rest = ~done[text]
            p, left, theta, slope, size = p[rest], left[~done], theta[~done], slope[~done], size[~done]
            text, first = np.repeat(np.arange(len(left)), size), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        theta = theta * slope / size[:, None]
    return out, likelihood


def mixtures(log_p: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions (0 outside the chosen set) and the number of its words with evidence."""
    buckets, k = log_p.shape
    code, first, per_text = _grams(raw, offsets, buckets)
    words = np.diff(per_text)
    out = np.zeros((len(words), k))
    has = np.flatnonzero(words)
    if not len(has) or not k:
        return out, words
    per_word, w = np.empty((len(first) - 1, k)), 0
    while w < len(per_word):  # some words at a time, as each n-gram has a number for every language
        upto = max(w + 1, int(np.searchsorted(first, first[w] + CELLS // k, "right")) - 1)
        per_word[w:upto] = np.add.reduceat(log_p[code[first[w] : first[upto]]], first[w:upto] - first[w])
        w = upto
    start = per_text[has]
    text = np.repeat(np.arange(len(has)), words[has])
    single = np.add.reduceat(per_word, start)
    best = single.argmax(1)
    theta = np.zeros((len(has), k))
    theta[np.arange(len(has)), best] = 1
    # The likelihood is concave: no mixture gains more than the steepest slope at the best single language promises.
    with np.errstate(over="ignore"):
        ratio = np.exp(per_word - per_word[np.arange(len(per_word)), best[text]][:, None])
    slope = (np.add.reduceat(ratio, start) - words[has][:, None]).max(1)
    todo = np.flatnonzero(slope > np.log(words[has]) / 2)
    if k > 1 and len(todo):
        logs, n = per_word[np.isin(text, todo)], words[has][todo]
        whole, most = _fit(logs, np.r_[0, np.cumsum(n)[:-1]], np.ones((len(todo), k), bool))
        rank = np.argsort(np.argsort(-whole, 1, kind="stable"), 1, kind="stable")
        level = single[todo, best[todo]]
        for size in range(2, k + 1):
            # No set is likelier than all languages together, so texts that can't gain at this size can't at a larger one.
            cost = (size - 1) * np.log(n) / 2
            can = most + TOLERANCE - cost > level
            if not can.all():
                logs = logs[np.repeat(can, n)]
                todo, n, rank, level, most, cost = todo[can], n[can], rank[can], level[can], most[can], cost[can]
            if not len(todo):
                break
            fitted, likelihood = _fit(logs, np.r_[0, np.cumsum(n)[:-1]], rank < size)
            better = likelihood - cost > level
            theta[todo[better]], level[better] = fitted[better], (likelihood - cost)[better]
    out[has] = theta
    return out, words


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str, keep_text: bool = False) -> DataFrame:
    """`keep` columns (and text), lang_pred, score, langs (language -> share, for the chosen set) for docs (text, *keep)."""
    languages, log_p = model
    sent = docs.sparkSession.sparkContext.broadcast(log_p)
    first = 0 if keep_text else 1
    size = max(1, min(shared.CHUNK_BYTES, 8 * CELLS // max(1, len(languages))))  # bytes of text at a time

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in shared.chunks(batches, 0, size):
            raw, offsets, letters = _lowered(batch.column(0))
            theta, words = mixtures(sent.value, raw, offsets)
            best = theta.argmax(1) if theta.shape[1] else np.zeros(len(theta), int)
            sure = np.array(letters) & (words > 0) & (theta.shape[1] > 0)
            pred = [languages[b] if s else "und" for b, s in zip(best, sure, strict=True)]
            score = np.where(sure, np.clip(theta.max(1, initial=0), 0, 1), 0.0)
            langs = [[(languages[j], float(row[j])) for j in np.flatnonzero(row)] if s else [] for row, s in zip(theta, sure, strict=True)]
            found = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(batch.columns[first:] + found, batch.schema.names[first:] + ["lang_pred", "score", "langs"])

    rows = docs.select("text", *keep)
    schema = StructType(rows.schema.fields[first:])
    for name, kind in (("lang_pred", StringType()), ("score", DoubleType()), ("langs", MapType(StringType(), DoubleType()))):
        schema = schema.add(name, kind)
    return rows.mapInArrow(of, schema)


def fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
