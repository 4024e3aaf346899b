import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import aliases, search

Q, V, R = "qid int, scope string, text string", "scope string, canonical string, alias string", "scope string, route string"


def brute(questions, vocabulary, routes):
    """The best route of each question by a look at every group, term and route. Texts are folded already."""
    out = {}
    for qid, scope, text in questions:
        groups = {}
        for s, canonical, alias in vocabulary:
            if s == scope and canonical is not None:
                groups.setdefault(canonical, {canonical}).update({alias} - {None, ""})
        mine = sorted({r for s, r in routes if s == scope and r and "[" not in r})
        has = lambda t: f" {t} " in f" {text} "  # noqa: B023,E731
        met = {c: {t for t in terms if has(t)} for c, terms in groups.items()}
        met = {c: t for c, t in met.items() if t}
        direct = []
        for c, t in met.items():
            named = [r for r in mine if r[1:] == c or r[1:].replace("/", " ").replace("-", " ") == c] or [r for r in mine if c in r.split("/")]
            if named:
                kept = [x for x in t if not any(x != y and x in y for y in t)]
                score = 10_000 * (c in t) + 5_000 * (text in t) + sum(map(len, kept))
                direct.append((-score, named[0], -max(map(len, t)), c in t))
        if direct:
            score, route, strength, own = min(direct)
            out[qid] = (route, -strength, own, -score)
        elif met:
            terms = set().union(*(groups[c] for c in met))
            loose = [r for r in mine if r[1:] in terms] or [r for r in mine if set(r.split("/")) & terms]
            if loose:
                out[qid] = (loose[0], max(len(x) for t in met.values() for x in t), False, None)
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, aliases.TERMS), (2, aliases.TERMS), (2, 0)])
def test_routes_equal_brute_force(spark, seed, most):
    rng = random.Random(seed)
    word = lambda: rng.choice(["loan", "card", "home", "loan-form", "a", "list", "kart", "new"])
    some = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    scopes = ["x", "y", None]
    questions = [(i, rng.choice(scopes), some(6)) for i in range(60)]
    vocabulary = [(rng.choice(scopes), some(2), rng.choice([some(3), None, ""])) for _ in range(25)]
    routes = [(rng.choice(scopes), "/" + "/".join(word() for _ in range(rng.randint(1, 3)))) for _ in range(20)] + [("x", "/loan/[id]"), ("y", None)]
    found = aliases.route_matches(spark.createDataFrame(questions + questions[:3], Q), spark.createDataFrame(vocabulary, V), spark.createDataFrame(routes, R), most)
    rows = found.collect()
    assert {r.qid: (r.route, r.strength, r.canonical_mentioned, r.score) for r in rows} == brute(questions, vocabulary, routes)
    assert len({r.qid for r in rows}) == len(rows)
    for r in rows:
        assert 0 < r.strength <= r.explained <= len(questions[r.qid][2])


def test_terms_are_folded_and_stand_alone(spark):
    questions = [(1, "x", "Where is the KART SİHİRBAZI page?"), (2, "x", "kartlar"), (3, "x", None), (4, "z", "kart sihirbazı")]
    vocabulary = [("x", "Kart-Sihirbazi", "kart sihirbazı"), ("x", "Kart-Sihirbazi", "Kart")]
    found = aliases.route_matches(spark.createDataFrame(questions, Q), spark.createDataFrame(vocabulary, V), spark.createDataFrame([("x", "/kart-sihirbazi")], R)).collect()
    assert [(r.qid, r.route, r.strength, r.score, r.explained) for r in found] == [(1, "/kart-sihirbazi", 14, 14, 14)]
    none = spark.createDataFrame([], V)
    assert aliases.route_matches(spark.createDataFrame(questions, Q), none, spark.createDataFrame([], R)).collect() == []


def test_cover_is_the_best_choice_of_spans():
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randrange(15) for _ in range(rng.randrange(7)))]
        apart = lambda some: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2))
        every = (c for n in range(len(spans) + 1) for c in itertools.combinations(sorted(set(spans)), n) if apart(c))
        assert aliases.cover(spans) == max(sum(b - a for a, b in c) for c in every)


def test_a_strong_alias_is_an_anchor(spark):
    schema = "id long, repository string, kind string, subject string, content string, confidence string, source_file string, commit_sha string, quality double, n_evidence int, n_located int, repository_sha string"
    rows = [(i, "shop", "rendering", f"route:/{name}", "page", "derived", "src/p.tsx", "s", None, 1, 0, "s") for i, name in enumerate(("home", "loans"))]
    facts = spark.createDataFrame(rows, schema)
    every = facts.select("id", F.array(F.lit("sql")).alias("channels"), F.lit(1).alias("best_rank"))
    first = lambda said: search.hybrid(facts, every, "what about credit cards", 5, (), said).first()
    assert first(("/loans", 12)).id == 1 and first(("/loans", 12)).score > first(("/loans", 5)).score
    assert first(("/home", 12)).id == 0
