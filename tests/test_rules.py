import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import rules, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("question", "intent", "confidence"),
    [
        ("Which routes are there? List all of them", "lookup", "medium"),
        ("Why does the call fail with 502 exception?", "debug", "high"),
        ("Bu değişikliğin etkilediği yerler: blast radius", "impact", "high"),
        ("Add a new page: how should I build it", "implementation-plan", "high"),
        ("hello", "unknown", "low"),
        (None, "unknown", "low"),
        ("lint flow", "unknown", "low"),  # a tie
    ],
)
def test_intent(spark, question, intent, confidence):
    got = one(spark, question, rules.intent)
    assert (got.intent, got.confidence) == (intent, confidence)


def test_memory_types(spark):
    assert one(spark, "Where is the cookie of the login session cached? Cache TTL", rules.memory_types) == ["authentication", "cache"]
    assert one(spark, "gtag payload", rules.memory_types) == ["analytics_event"]
    assert one(spark, "gtag payload schema", rules.memory_types) == ["schema_contract", "analytics_event"]
    assert one(spark, "nothing", rules.memory_types) == []


@pytest.mark.parametrize(
    ("path", "kinds"),
    [
        ("package.json", ["repository", "build"]),
        ("next.config.ts", ["repository", "route", "configuration", "build", "security"]),
        ("src\\middleware.ts", ["middleware", "authentication", "route", "security"]),
        ("deep/.env.production", ["configuration", "security"]),
        ("src/app/x/robots.txt", ["seo", "configuration"]),
        ("README.md", []),
    ],
)
def test_path_kinds(spark, path, kinds):
    assert one(spark, path, rules.path_kinds) == kinds


def test_source_paths(spark):
    page = one(spark, "app/page.tsx", rules.path_kinds)
    assert page[-1] == "route" and len(page) == len(set(page)) == 12
    assert one(spark, "lib/x.js", rules.path_kinds) == page[:-1]


@pytest.mark.parametrize(("version", "major"), [("^15.1.0", 15), ("next@14.2", 14), ("~13.4", 13), (">= v12.1", 12), ("canary", None), (None, None), ("next-16.0", 16)])
def test_next_major(spark, version, major):
    assert one(spark, version, rules.next_major) == major


def test_packages_and_owners(spark):
    got = [one(spark, n, lambda c: rules.package_category(c, "@own/")) for n in ("@own/ui", "react", "react-query", "x-analytics", "left-pad")]
    assert got == ["internal-package", "framework/runtime", "data-fetching", "analytics", None]
    assert one(spark, "repository-fact", rules.owner) == "context-engine" and one(spark, "x", rules.owner) is None


def test_decisions(spark):
    good = ("adr-001", "Use Spark", "Because it scales out", "adr", "docs/adr/1.md#why", None, "ann", "2026-01-02T03:04:05Z")
    cases = {
        None: {},
        "key": {0: "a"},
        "title": {1: " x "},
        "rationale": {2: "short"},
        "source-ref": {4: " "},
        "adr-not-markdown": {4: "docs/adr/1.txt"},
        "source-sha": {5: "abc"},
        "approved-by": {6: ""},
        "approved-at": {7: "yesterday"},
    }
    rows = [(*(changed.get(i, v) for i, v in enumerate(good)), str(fault)) for fault, changed in cases.items()]
    names = ["key", "title", "rationale", "source_kind", "source_ref", "source_sha", "approved_by", "approved_at"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in [*names, "fault"]))
    assert all(str(r.got) == r.fault for r in df.select("fault", rules.decision_fault(*map(F.col, names)).alias("got")).collect())


def test_miss_class_and_shape(spark):
    rows = [("x", None, 3, None), (None, "Seed could not be resolved", 3, None), (None, "semantic graph UNAVAILABLE", 1, None), (None, None, None, None), (None, "", 2, "targeted-source"), (None, None, 2, "none")]
    df = spark.createDataFrame(rows, "error string, gaps string, results int, fallback string")
    got = [r.m for r in df.select(rules.miss_class(*map(F.col, df.columns)).alias("m")).collect()]
    assert got == ["engine-error", "wrong-intent", "engine-error", "missing-fact", "missing-evidence", None]
    shape = one(spark, "Where is API_URL read in src/app.ts for /home?", rules.question_shape)
    assert (shape.words, shape.bucket, shape.turkish, shape.route, shape.file, shape.config) == (8, "s", False, True, True, True)


def test_bare_symbols_and_asked_versions(spark):
    said = ["Where is getInterestOppList called from src/a/b.ts#Page?", "Next 16 or later", "next.js version 15", "nothing here", "aB x1 fooBar_$"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, q string")
    files, symbols = text.qualified_anchors(F.col("q"))
    got = {r.i: (r.f, r.s, r.m) for r in df.select("i", files.alias("f"), symbols.alias("s"), rules.asked_major(F.col("q")).alias("m")).collect()}
    assert got[0] == (["src/a/b.ts"], ["src/a/b.ts#Page", "getInterestOppList"], None)
    assert [got[i][2] for i in range(4)] == [None, 16, 15, None] and got[4][1] == ["aB", "fooBar_"]


def test_words_are_found_by_stem_and_pattern_as_by_borders(spark):
    patterns = [*rules.TYPE_TERMS.values(), rules.SCHEMA_WORDS]
    assert all(text.word_stems(p) for p in patterns) and "\\b" not in "".join(map(text.ascii_words, patterns))
    assert text.word_stems(r"\b(role|rol|event\s+x|redirects?|authoriz(?:e|ation)|next\.config)\b") == ["authoriz", "event", "next.config", "redirect", "rol"]
    assert not text.word_stems(r"\b(a?b|c)\b") and not text.word_stems(r"\b(a|)\b") and not text.word_stems(r"x\b(a)\b") and not text.word_stems(r"\b(a)\b|(c)\b")
    rng = random.Random(5)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z]+(?:[-. ][a-z]+)*", p)}) + ["404", "5xx", "redirect", "authorize", "authorization", "analytics  events", "event\npayload", "next.config", "nextxconfig"]
    sides = ["", " ", "-", "_", "x", "1", "\u00e9", "\u0131", "\u212a", "\n", "."]
    cased = [str.upper, str.lower, str.title, str]
    said = ["".join(rng.choice(sides) + rng.choice(cased)(rng.choice(words)) + rng.choice(sides) for _ in range(2)) for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, q string")
    for r in df.select("q", F.array(*[text.found_in(F.col("q"), p) for p in patterns]).alias("f")).collect():
        assert r.f == [bool(re.search(p, r.q, re.ASCII | re.IGNORECASE)) for p in patterns], r.q
