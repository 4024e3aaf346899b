"""Pieces against the library that the model belongs to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestrata.llm import queries, sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def assert_same(library, texts):
    model = sentencepieces.model(PATH)
    ids, first = sentencepieces.encode(model, texts)
    lists = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert lists == library.encode([t or "" for t in texts], num_threads=1)
    assert sentencepieces.decode(model, ids.astype(np.int64), first) == [library.decode(x) for x in lists]


def test_odd_texts(library):
    assert_same(library, [None, "", " ", "  ", "\n", "▁", "▁▁ a", " a", "a ", "<s>", "</s> <unk>", "<0x0A>", "中文字 測試", "é🙂𝕏\x00", "a" * 200, " " * 40 + "x"])


@pytest.mark.parametrize("alphabet", ["abcdefghij klmnop ▁\n.,-_=/(){}0123456789éüß中文🙂ЖБя   ", "ab ", "-=* /", "the in"])
def test_random_texts(library, alphabet):
    rnd = random.Random(alphabet)
    assert_same(library, ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(2000)])


def test_pieces_side_by_side(library):
    rnd = random.Random(4)
    assert_same(library, ["".join(library.id_to_piece(rnd.randrange(259, 32000)) for _ in range(6)) for _ in range(2000)])


def test_long_words_and_parts(library, monkeypatch):
    rnd = random.Random(5)
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    texts = [letters, "-" * 3000, " " * 3000, "x " * 3000, letters[:600] + "  " + letters]
    assert_same(library, texts)
    monkeypatch.setattr(sentencepieces, "PIECE", 50)
    assert_same(library, texts + ["a few words and  more"] * 9)


def test_words_with_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(sentencepieces.shared, "hashed", lambda raw, a, b: np.zeros(len(a), np.uint64))
    assert_same(library, ["the quick brown fox jumps over the lazy dog", "quick quick lazy"])


def test_any_ids_are_decoded(library):
    rnd = random.Random(6)
    lists = [[rnd.randrange(32000 if rnd.random() < 0.4 else 259) for _ in range(rnd.randrange(20))] for _ in range(3000)]
    flat, first = np.array(sum(lists, []), np.int64), np.r_[0, np.cumsum([len(x) for x in lists])]
    assert sentencepieces.decode(sentencepieces.model(PATH), flat, first) == [library.decode(x) for x in lists]


def test_other_kinds_of_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        sentencepieces.Model(str(tmp_path / "none"))


def test_rows(spark, odd, library):
    both = odd.selectExpr("doc_id", "text", "lang as ids", "text as said")
    got = sentencepieces.decode_pieces(sentencepieces.encode_pieces(both, PATH, "doc_id", "said"), PATH).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.ids == library.encode(r.said or "")
        assert r.text == library.decode(r.ids)
    empty = sentencepieces.encode_pieces(odd.limit(0), PATH, "doc_id")
    assert sentencepieces.decode_pieces(empty, PATH).collect() == []


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op12_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
