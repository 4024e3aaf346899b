import math
import random
import re
from collections import Counter

import pytest

from lodestrata.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def rows_of(result):
    return {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in result.collect()}


def test_measures_equal_brute_force(odd, documents):
    texts = ["a b c a b c a", "a b c d a b c d", "x\nx\n\n \n x\ny", "a a a a", "#*$% &|<> é", "p q r s t p q r"]
    docs = odd.unionByName(documents(list(enumerate(texts, 100)))).withColumn("w", odd.lang).withColumn("votes", odd.lang)
    expected = {(r.doc_id, *brute(r.text)) for r in docs.collect()}
    assert rows_of(q.quality(docs)) == expected


def plain_em(rows, tolerance=q.TOLERANCE):
    """EM over single documents by plain loops until nothing changes: the posterior of being good for each row of votes."""
    k = len(q.RULES)
    start = [[0.8, 0.02, 0.18]] * k
    table = [start] + [[[0.1, 0.8, 0.1] if r == c else [0.6, 0.15, 0.25] for r in range(k)] for c in range(k)]
    prior = [0.8] + [0.2 / k] * k
    place = {1: 0, 0: 1, -1: 2}
    belongs, changed = [[0.0] * (k + 1)] * len(rows), 1.0
    while changed > tolerance:
        before, belongs = belongs, []
        for votes in rows:
            odds = [prior[c] * math.prod(table[c][r][place[v]] for r, v in enumerate(votes)) for c in range(k + 1)]
            belongs.append([x / sum(odds) for x in odds])
        changed = max(abs(x - y) for b, a in zip(belongs, before, strict=True) for x, y in zip(b, a, strict=True))
        size = [sum(b[c] for b in belongs) for c in range(k + 1)]
        prior = [(size[c] + 0.1) / (len(rows) + 0.1 * (k + 1)) for c in range(k + 1)]
        table = [
            [[(sum(b[c] for b, votes in zip(belongs, rows, strict=True) if place[votes[r]] == v) + 0.1 * [0.6, 0.15, 0.25][v]) / (size[c] + 0.1) for v in range(3)] for r in range(k)]
            for c in range(k + 1)
        ]
    return [b[0] for b in belongs]


def test_em_equals_plain_loops_over_documents():
    rng = random.Random(3)
    patterns = [tuple(rng.choice((1, 1, 0, -1)) for _ in q.RULES) for _ in range(6)]
    counts = [rng.randint(1, 9) for _ in patterns]
    p_good, accuracy = q.learn(patterns, counts, 1e-4)
    rows = [p for p, n in zip(patterns, counts, strict=True) for _ in range(n)]
    plain = plain_em(rows, 1e-4)
    assert [x for x, n in zip(p_good, counts, strict=True) for _ in range(n)] == pytest.approx(plain, abs=1e-6)
    assert len(accuracy) == len(q.RULES) and all(0 <= a <= 1 for a in accuracy)


def test_em_separates_junk(documents):
    def prose(i):
        return f"Plain sentences number {i} follow here, " + " ".join(f"word{i * 97 + k} and" if k % 3 else f"other{k + i}." for k in range(70))

    rows = [(i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], prose(i))) for i in range(60)]
    rows += [(100 + i, " ".join(f"{x}$$$ ***" for x in rows[i][1].split())) for i in range(8)]
    rows += [(200 + i, " ".join(f"{x.upper()}!!" for x in rows[i][1].split())) for i in range(8)]
    got = {r.doc_id: r.kept for r in q.quality(documents(rows)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in got if i >= 100)


def test_labelled_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = q.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_one_sided_and_empty(documents):
    assert q.quality(documents([])).collect() == []
    assert [r.kept for r in q.quality(documents([(1, "short")])).collect()] == [False]


def test_no_python_in_the_plan(odd):
    plan = q.features(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
