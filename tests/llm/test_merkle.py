"""The manifest against a tree in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in doc))


def climb(hashes, arity):
    """The root and each leaf's (before, after) on the way up."""
    ways, below = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        runs = [(hashes[i : i + arity], below[i : i + arity]) for i in range(0, len(hashes), arity)]
        for run, leaves in runs:
            for k, under in enumerate(leaves):
                for i in under:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        hashes, below = [h(*run) for run, _ in runs], [sum(leaves, []) for _, leaves in runs]
    return hashes[0], ways


def brute(docs, arity):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    trees = {g: climb([leaf(d) for d in groups[g]], arity) for g in names}
    root, tops = climb([trees[g][0] for g in names], arity) if names else ("", [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for d, way in zip(groups[g], trees[g][1], strict=True):
            picked = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            seen = leaf((*d[:3], d[3] + 1 if picked and d[3] is not None else d[3], d[4]))
            for before, after in way + top:
                seen = h(before, seen, after)
            out.append((d[0], leaf(d), trees[g][0], root, h(*(a + b for a, b in way + top)), seen, seen == root))
    return sorted(out, key=str)


def got(docs, arity):
    found = merkle.document_manifest(docs, arity)
    proof = F.sha2(merkle.siblings(F.col("steps")), 256)
    return sorted(map(tuple, found.select("id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("n", "arity", "block"), [(0, 2, 1024), (1, 2, 1024), (60, 2, 4), (333, 2, 1024), (120, 3, 9)])
def test_against_plain_tree(spark, monkeypatch, n, arity, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rnd = random.Random(n)
    langs = ["en", "en", "en", "en", "de", None, "é", "zz"]
    docs = [
        (rnd.choice([None, *range(n)]), rnd.choice([None, "s", "ü"]), rnd.choice(langs), rnd.choice([None, 5, 2**63 - 1]), rnd.choice([None, "", "héé a", "x" * 5000]))
        for _ in range(n)
    ]
    docs += docs[:3]  # repeated rows
    assert got(spark.createDataFrame(docs, SCHEMA), arity) == brute(docs, arity)


def test_one_group_over_blocks_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    docs = [(i, "s", "en", i, f"text {i}") for i in range(37)]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA + ", hash string, at int")
    assert got(rows, 2) == brute(docs, 2)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 5, "t") for i in range(40)], SCHEMA)
    wrong = {r.id for r in merkle.document_manifest(docs).where("not verified").collect()}
    assert wrong == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
