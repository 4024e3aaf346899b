import itertools
import math
import re
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_decontamination import words as alnum_words
from test_mixing import plain_mix
from test_sstable import expected as plain_tokens

from lodestrata.llm import mixing, queries
from lodestrata.llm.shared import stored


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    rows = docs.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def plain_language_id(rows):
    """Rows stay that have a word with a letter."""
    return [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]


def plain_near_duplicates(rows):
    """Of rows linked by five-word shingle sets with a Jaccard of 0.8 or more, that with the smallest id stays."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    holders: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter(pair for h in holders.values() for pair in itertools.combinations(h, 2))
    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least: dict = {}
    for i, r in enumerate(rows):
        least[group[i]] = min(least.get(group[i], r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if r["doc_id"] == least[group[i]]]


def plain_decontaminate(rows, items):
    """Rows go of which a twentieth or more of the words lies in windows of 13 words of an item, or in a whole shorter one."""
    windows: dict[int, set] = {}
    for t in items:
        w = alnum_words(t)
        n = min(13, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    kept = []
    for r in rows:
        w = alnum_words(r["text"])
        hit = {k for n, of in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in of for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r)
    return kept


def plain_mixed(spark, rows):
    """A row appears as often as the mix takes it. The targets are the operator's: a last bit of theirs can be a word more or less."""
    size = Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    taken = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in rows], mixing.BLOCK, goal)
    times = {i: math.ceil(taken / size) for i, size, taken, _ in taken if taken}
    return [r for r in rows for _ in range(times.get(r["doc_id"], 0))]


def test_stages_equal_plain_loops(spark, sf_dir):
    """Each stage on what the one before kept, against a version without Spark; ids are unique in this table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = [plain_language_id, plain_near_duplicates, lambda rows: plain_decontaminate(rows, items), lambda rows: plain_mixed(spark, rows)]
    key = lambda rows, *columns: sorted(tuple(str(r[c]) for c in columns) for r in rows)
    for (name, stage), version in zip(cp.STAGES, plain, strict=False):
        rows = docs.collect()
        docs = stored(stage(spark, docs, sf_dir), f"plain-{name}")
        left = version(rows)
        columns = [c for c in docs.columns if name != "language_id" or c != "lang"]
        assert key(docs.collect(), *columns) == key(left, *columns), name
        assert len(left) != len(rows) or name == "language_id"
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in cp.token_output(spark, docs, sf_dir).collect()), key=lambda r: r[1])
    assert got == plain_tokens(rows)


def test_empty_and_odd_tables(spark, sf_dir, odd):
    for docs in (odd.limit(0), odd.withColumns({c: F.lit("a") for c in ("row", "size", "score", "lang_pred", "gone", "bad_id", "mixed_id", "times", "copy", "__copy", "copy_", "c0")})):
        for name, stage in cp.STAGES[:-1]:
            columns, docs = docs.columns, stored(stage(spark, docs, sf_dir), f"odd-{name}")
            assert docs.columns == columns
        assert cp.STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_near_duplicates_leave_one(spark, sf_dir, documents):
    base = [f"w{i}" for i in range(120)]
    rows = [(5, " ".join(base)), (3, " ".join([*base[:-2], "x", "y"])), (9, " ".join(base)), (1, "quite another text")]
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, documents(rows), sf_dir).collect()) == [1, 3]


def test_rows_of_null_and_repeated_ids_are_judged_alone(spark, tmp_path, documents):
    bad, good = " ".join(f"b{i}" for i in range(30)), [f"g{i}" for i in range(120)]
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, bad), (None, "clean one"), (7, bad), (7, "clean two"), (None, None)]
    left = cp.decontaminate(spark, documents(rows), str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in left.where("text is not null").collect()) == [("7", "clean two"), ("None", "clean one")]
    assert left.count() == 3
    first, near = " ".join(good), " ".join([*good[:-2], "x", "y"])
    only, twin = "a text of its own that is like no other", "another text here, written down twice"
    rows = [(3, first), (5, near), (5, only), (None, near), (8, twin), (8, twin), (None, "none " + twin), (None, "none " + twin), (None, None), (None, None)]
    left = [(str(r.doc_id), r.text) for r in cp.near_duplicates(spark, documents(rows), str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([("3", first), ("5", only), ("8", twin), ("None", "none " + twin), ("None", None), ("None", None)], key=str)


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)


def test_unlike_texts_of_one_hash_all_stay(spark, sf_dir, documents, monkeypatch):
    monkeypatch.setattr(cp, "_hash", lambda *values: F.length(values[-1]).cast("long") if len(values) == 1 else F.xxhash64(*values))
    rows = [(1, "one text of some words here"), (2, "two more words of that kind"), (3, "one text of some words here"), (4, "a longer text that stands alone"), (None, "six new words: of that kind")]
    assert len({len(t) for _, t in rows}) == 2
    assert sorted(str(r.doc_id) for r in cp.near_duplicates(spark, documents(rows), sf_dir).collect()) == ["1", "2", "4", "None"]
