import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import sstable
from lodestrata.llm.shared import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_and_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in sstable.token_shards(odd.withColumn("path", odd.lang), PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def test_spaces_and_special_strings(documents):
    rows = [(i, t) for i, t in enumerate(["a  b", " a b ", "a \n b", "it's <|endoftext|> x", "  a  b é c", "x᠎ y", "1 2 ,3 . 'll"])]
    got = [tuple(r) for r in sstable.token_shards(documents(rows), PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
    return [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(raw, offsets)]


#: What pre-tokenizers treat differently: white space of all kinds, endings, signs among letters, an added token, other scripts.
PARTS = ["a", "b", "é", "Ö", "1", "2", ".", ",", "'", "'s", "'re", "'ll", "'d", "'t", "'S", "''", " ", "  ", "\n", "\t", "\r\n", "\x0b"]
PARTS += ["\x1c", "\x00", "\xa0", "\x85", "×", "÷", "漢", "🙂", "ł", "\u180e", "\u200b", "²", "ª", "<|endoftext|>", "x's y", "_", "internationalization "]


@pytest.mark.parametrize("piece_bytes", [sstable.PIECE_BYTES, 150])
def test_ids_equal_those_of_the_unmodified_tokenizer(monkeypatch, piece_bytes):
    monkeypatch.setattr(sstable, "PIECE_BYTES", piece_bytes)
    monkeypatch.setattr(sstable, "SLOT_BITS", 6)  # slots are taken from each other all the time
    monkeypatch.setattr(sstable, "LONG_CACHE", 5)
    tok, encoder, rng = Tokenizer.from_file(PATH), sstable.Encoder(PATH, 2), random.Random(1)
    for i in range(400):
        parts = PARTS if i % 2 else [p for p in PARTS if p != "<|endoftext|>"]
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice((0, 3, 12, 200)))) for _ in range(rng.randint(1, 6))]
        assert encoded(encoder, texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_themselves(documents):
    got = sstable.token_shards(documents([(1, "a <|endoftext|> b")]), PATH).first()
    assert got.n_tokens == 5 and encoded(sstable.Encoder(PATH, 2), ["<|endoftext|>"]) == [[50256]]


def test_other_kinds_of_tokenizers_are_used_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["A word, and  another", "", "été"]
    assert encoded(sstable.Encoder(path, 2), texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_lookup(spark, documents):
    rows = [(i * 3 - 500, f"text number {i} " * (i % 7)) for i in range(800)]
    folder = shared_dir(spark, "lookup")
    manifest = sstable.write_shards(documents(rows), PATH, folder).collect()
    readers = [(m.first_id, m.last_id, sstable.Reader(m.path)) for m in manifest]
    tok = Tokenizer.from_file(PATH)
    for doc_id, text in rows[::37]:
        reader = next(r for a, b, r in readers if a <= doc_id <= b)
        assert reader.get(doc_id).tolist() == tok.encode(text).ids + [0]
        assert reader.get(doc_id + 1) is None
    assert sum(r.docs for _, _, r in readers) == 800


def test_several_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    path = tmp_path / "x.sst"
    writer = sstable.Writer(open(path, "wb"), 2)  # noqa: SIM115
    for i in range(300):
        writer.add(sstable.key_of(i), np.full(i % 9 + 1, i, "<u2").tobytes())
    writer.close()
    reader = sstable.Reader(str(path))
    assert len(reader.index) > 10
    assert [sstable.id_of(k) for k, _ in reader] == list(range(300))
    assert all(reader.get(i).tolist() == [i] * (i % 9 + 1) for i in range(300)) and reader.get(300) is None


def test_empty_table(documents):
    assert sstable.token_shards(documents([]), PATH).collect() == []


def test_a_hot_id_fills_several_files(spark, documents):
    """Rows of one id are no single task's: they lie in several files, in one order."""
    rows = [(None if i % 3 else 7, f"text {i % 40} of a hot id") for i in range(900)] + [(7, "the same")] * 300
    docs = documents(rows).repartition(6).cache()
    folder = shared_dir(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        manifest = sstable.write_shards(docs, PATH, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = manifest.collect()
    assert sum(f.docs for f in files) == 1200 and sum(f.first_id is None for f in files) > 1 and sum(f.last_id == 7 for f in files) > 1
    tok = Tokenizer.from_file(PATH)
    got = sstable.read_shards(manifest).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t).ids, 0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
