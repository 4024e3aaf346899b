import re
import zlib

import numpy as np

from lodestrata.llm import language as lang


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", lang.fold() == 1)
    model = lang.train(docs.where("not held_out"))
    rows = lang.identify(docs, model, "doc_id", "held_out", "lang").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_of_two_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lang.train(docs)
    long = {k: [r.text for r in docs.where(f"lang = '{k}' and n_chars > 1500").limit(2).collect()] for k in ("en", "fr")}
    mixed = spark.createDataFrame([(1, long["en"][0][:1400] + " " + long["fr"][0][:700])], "doc_id long, text string")
    row = lang.identify(mixed, model, "doc_id").first()
    assert row.lang_pred == "en" and set(row.langs) == {"en", "fr"} and 0.5 < row.score < 0.85


def test_hundreds_of_languages_have_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(lang, "CELLS", 300 * 50)  # a few words at a time
    rng = np.random.default_rng(3)
    words = {f"l{i:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(20)] for i in range(300)}
    rows = spark.createDataFrame([(i, " ".join(w), name) for i, (name, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    languages, log_p = lang.train(rows)
    assert languages == sorted(words) and log_p.shape == (lang.BUCKETS, 300)
    found = lang.identify(rows, (languages, log_p), "lang").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 297


def grams(text, buckets):
    """Per word with a letter: the buckets of its byte 4-grams, by plain loops."""
    out = []
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()):
        marked = b"\0" + word + b"\0"
        parts = [marked[i : i + 4] for i in range(max(1, len(marked) - 3))]
        out.append([(int.from_bytes(g.ljust(4, b"\0"), "big") * 2654435761 % 2**32 >> 16) % buckets for g in parts])
    return out


def plain_em(words, allowed):
    """Shares of the allowed columns and the log likelihood, by many plain rounds."""
    p = words[:, allowed]
    top = p.max(1, keepdims=True)
    p, theta = np.exp(p - top), np.full(len(allowed), 1 / len(allowed))
    for _ in range(3000):
        theta = (p * theta / (p @ theta)[:, None]).mean(0)
    return theta, float((np.log(p @ theta) + top[:, 0]).sum())


def test_model_and_mixtures_equal_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, log_p = lang.train(docs)
    rows = docs.select("doc_id", "text", "lang").collect()
    counts, buckets = np.zeros((lang.BUCKETS, len(languages))), lang.BUCKETS
    for r in rows:
        if r.lang is not None and r.text is not None:
            for b in grams(r.text, buckets):
                np.add.at(counts[:, languages.index(r.lang)], b, 1)
    mean = (counts.sum(1) + 1) / (counts.sum() + buckets)
    assert np.allclose(log_p, np.log((counts + 50 * mean[:, None] * buckets / 64) / (counts.sum(0) + 50 * buckets / 64)), atol=1e-5)
    long = [" ".join(r.text for r in rows if r.lang == x and r.text)[2000:3000] for x in languages]
    texts = [r.text for r in rows if r.text and len(r.text) < 1500][:40] + [long[0] + long[1], long[0][:600] + long[2][:300] + long[3], " ".join(long)]
    found = lang.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (languages, log_p), "doc_id").collect()
    for r in found:
        words = np.array([log_p[b].astype(float).sum(0) for b in grams(texts[r.doc_id], buckets)]).reshape(-1, len(languages))
        if not len(words):
            assert r.lang_pred == "und"
            continue
        order = np.argsort(-plain_em(words, list(range(len(languages))))[0], kind="stable")
        single = int(words.sum(0).argmax())
        best = (float(words[:, single].sum()), {single: 1.0})
        for size in range(2, len(languages) + 1):
            theta, likelihood = plain_em(words, list(order[:size]))
            if likelihood - (size - 1) * np.log(len(words)) / 2 > best[0] + 0.02:
                best = (likelihood - (size - 1) * np.log(len(words)) / 2, dict(zip(order[:size].tolist(), theta, strict=True)))
        assert r.lang_pred == languages[max(best[1], key=best[1].get)]
        assert all(abs(r.langs.get(languages[i], 0) - best[1].get(i, 0)) < 0.03 for i in range(len(languages)))


def test_single_language_needs_no_second(spark):
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(lang.BUCKETS) * 0.05, 2).T + 1e-9).astype(np.float32)
    raw = np.frombuffer(b"abc def ghi", np.uint8)
    theta, words = lang.mixtures(log_p, raw, np.array([0, 0, 11, 11]))
    assert words.tolist() == [0, 3, 0] and theta[0].sum() == 0 and abs(theta[1].sum() - 1) < 1e-9


def test_a_set_may_have_every_language():
    rng = np.random.default_rng(1)
    k, size = 6, 400
    log_p = np.log(rng.dirichlet(np.ones(lang.BUCKETS) * 0.05, k).T + 1e-9).astype(np.float32)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    raw = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    code, first, _ = lang._grams(raw, np.array([0, len(raw)]), lang.BUCKETS)
    of = np.add.reduceat(log_p[code], first[:-1]).argmax(1)
    text = " ".join(w for j, n in enumerate([size] * 3 + [size // 2, size // 4]) for w in [w for w, x in zip(vocabulary, of, strict=True) if x == j][:n]).encode()
    theta, words = lang.mixtures(log_p, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.flatnonzero(theta[0]).tolist() == [0, 1, 2, 3, 4]
    assert np.allclose(theta[0][:5] * words[0], [size] * 3 + [size // 2, size // 4], atol=10)


def test_fit_has_converged():
    rng = np.random.default_rng(2)
    # Two languages that are much alike: the small share is found slowly.
    p = np.c_[np.ones(3000), np.where(rng.random(3000) < 0.5, 1.25, 0.8)]
    theta, likelihood = lang._fit(np.log(p), np.array([0]), np.ones((1, 2), bool))
    best = max(np.log(p @ [1 - x, x]).sum() for x in np.linspace(0, 1, 10001))
    assert best - lang.TOLERANCE <= likelihood[0] <= best + 0.001
    assert abs(theta[0].sum() - 1) < 1e-9


def test_odd_rows(odd, documents):
    docs = odd.withColumn("score", odd.lang)
    rows = lang.identify(docs, lang.train(docs), "doc_id", keep_text=True).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].lang_pred for i in (1, 2, 3, -8)] == ["und"] * 4 and by[1].score == 0 and by[7].text.startswith("long")
    assert by[6].lang_pred == "de"
    empty = documents([])
    assert lang.identify(docs, lang.train(empty), "doc_id").select("lang_pred").distinct().first()[0] == "und"
    assert lang.identify(empty, lang.train(docs), "doc_id").collect() == []
