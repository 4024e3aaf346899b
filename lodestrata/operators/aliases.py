"""Project vocabulary: which alias groups questions mention, how much of a question they explain, and the route they stand for.

A group is a canonical name and its aliases, within a scope (a repository); a question only meets the groups of its scope. Terms are
folded (lower case, no marks, single blanks) and count where they stand between blanks. All different terms are looked for at once by
one automaton, which is broadcast if they are counted to be TERMS at most; beyond, the questions' word sequences, as long as the
longest term, meet the terms in a join. Both give the same mentions.

A group's strength is the length of its longest mentioned term; its coverage the total length of its mentioned terms but for those
inside another one; its score adds 10,000 if the canonical name is mentioned and 5,000 if a term is the whole question. A group
stands for the route whose path is its canonical name (with blanks for marks as well), else for one with such a segment. Of a
question's groups with a route the best score counts, then the smaller route. If none has a route, a route counts whose path, or
else a segment of it, is any term of the mentioned groups.

Over all groups, `explained` is the largest total length of mentions of a question that don't overlap (weighted intervals).

Defined results: null texts, terms, canonical names and routes are left out; a null scope is a scope; repeated rows count once; a
question without mentions has no row; routes with parameters (`[`) stand for nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from lodestrata.functions.text import fold as plain_fold
from lodestrata.sources.storage import stored

#: Different terms up to which the automaton is broadcast.
TERMS = 200_000
# What a canonical name and a whole question add to a score.
CANONICAL, WHOLE = 10_000, 5_000


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain_fold(c), r"[^a-z0-9_@./\[\]-]+", " "))


def cover(spans: list[tuple[int, int]]) -> int:
    """The largest total length of spans (start, end) that don't overlap."""
    spans = sorted(set(spans), key=lambda s: s[1])
    ends, best = [s[1] for s in spans], [0]
    for i, (start, end) in enumerate(spans):
        best.append(max(best[-1], best[bisect.bisect_right(ends, start, 0, i)] + end - start))
    return best[-1]


def _found(automaton):
    """Adds `mentions`, the different terms of a folded text, and `explained`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for batch in batches:
            terms, explained = [], []
            for text in batch.column("folded").to_pylist():
                # Matches are of the term between its blanks; `end` is that of the blank behind it.
                at = [(end, term) for end, term in machine.iter(f" {text} ")] if len(machine) else []
                terms.append(sorted({t for _, t in at}))
                explained.append(cover([(end - 1 - len(t), end - 1) for end, t in at]))
            columns = [*batch.columns, pa.array(terms, pa.list_(pa.string())), pa.array(explained, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "mentions", "explained"])

    return of


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`mentions` (start, term) of a text as its different terms and what they explain."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        terms = pa.array([sorted({s["term"] for s in x}) for x in spans], pa.list_(pa.string()))
        explained = pa.array([cover([(s["start"], s["start"] + len(s["term"])) for s in x]) for x in spans], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("qid", "scope", "folded")), terms, explained], ["qid", "scope", "folded", "mentions", "explained"])


def mentions(questions: DataFrame, terms: DataFrame, most: int = TERMS) -> DataFrame:
    """qid, scope, folded, mentions (different terms, sorted), explained of questions (qid, scope, text), given folded terms (term)."""
    asked = questions.where("text is not null").select("qid", "scope", folded(F.col("text")).alias("folded")).distinct()
    known = stored(terms.where("term is not null and term <> ''").select("term").distinct(), "terms")
    schema = StructType([*asked.schema.fields]).add("mentions", ArrayType(StringType())).add("explained", LongType())
    if known.limit(most + 1).count() <= most:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for row in known.toLocalIterator():
            machine.add_word(f" {row['term']} ", row["term"])
        if len(machine):
            machine.make_automaton()
        return asked.mapInArrow(_found(asked.sparkSession.sparkContext.broadcast(machine)), schema)
    longest = known.agg(F.max(F.size(F.split("term", " ")))).first()[0]
    words = F.split("folded", " ")
    some = asked.withColumn("w", words).select("*", F.posexplode(F.sequence(F.lit(1), F.size("w"))).alias("i0", "first"))
    some = some.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("first") + 1))).alias("n"))
    before = F.col("first") - 1
    start = F.when(before == 0, 0).otherwise(F.length(F.array_join(F.slice("w", F.lit(1), before), " ")) + 1)
    term = F.array_join(F.slice("w", F.col("first"), F.col("n")), " ")
    met = some.select("qid", "scope", "folded", start.alias("start"), term.alias("term")).join(known, "term")
    spans = met.groupBy("qid", "scope", "folded").agg(F.collect_list(F.struct("start", "term")).alias("spans"))
    return spans.mapInArrow(_joined, schema)


def _coverage(terms: Column) -> Column:
    """Total length of the terms but for those inside another one."""
    inner = lambda t: F.exists(terms, lambda u: (u != t) & F.contains(u, t))
    return F.aggregate(F.filter(terms, lambda t: ~inner(t)), F.lit(0), lambda s, t: s + F.length(t))


def route_matches(questions: DataFrame, vocabulary: DataFrame, routes: DataFrame, most: int = TERMS) -> DataFrame:
    """qid, scope, route, strength, canonical_mentioned, score, explained: the route that each question's vocabulary names best.

    questions: qid, scope, text; vocabulary: scope, canonical, alias; routes: scope, route. score is null for a route that only
    some term of the groups names.
    """
    groups = vocabulary.where("canonical is not null").select("scope", F.col("canonical").alias("name"), folded(F.col("canonical")).alias("canonical"), folded(F.col("alias")).alias("alias"))
    each = F.explode(F.array(F.struct(F.col("canonical").alias("term"), F.lit(True).alias("own")), F.struct(F.col("alias").alias("term"), F.lit(False).alias("own"))))
    terms = groups.select("scope", "name", "canonical", each.alias("t")).select("scope", "name", "canonical", "t.*").where("term is not null and term <> ''")
    terms = stored(terms.groupBy("scope", "name", "canonical", "term").agg(F.max("own").alias("own")), "vocabulary")
    said = stored(mentions(questions, terms, most).where(F.size("mentions") > 0), "mentions")
    met = said.select("qid", F.col("scope").alias("of"), "folded", "explained", F.explode("mentions").alias("term"))
    rows = met.join(terms, (met["term"] == terms["term"]) & met["of"].eqNullSafe(terms["scope"])).drop(terms["term"])
    by_group = rows.groupBy("qid", "scope", "folded", "explained", "name", "canonical").agg(F.collect_set("term").alias("terms"), F.max("own").alias("own"))
    by_group = by_group.withColumn("strength", F.array_max(F.transform("terms", F.length)))
    whole = F.when(F.array_contains("terms", F.col("folded")), WHOLE).otherwise(0)
    by_group = stored(by_group.withColumn("score", F.when(F.col("own"), CANONICAL).otherwise(0) + whole + _coverage(F.col("terms"))), "groups")

    static = routes.where("route is not null and not contains(route, '[')").select("scope", "route").distinct()
    path, segments = F.regexp_replace("route", "^/", ""), F.array_remove(F.split("route", "/"), "")
    as_path = F.struct(folded(path).alias("key"), F.lit(0).alias("rank"))
    as_words = F.struct(folded(F.regexp_replace(path, "[-_/]+", " ")).alias("key"), F.lit(1).alias("rank"))
    as_parts = F.transform(segments, lambda s: F.struct(folded(s).alias("key"), F.lit(2).alias("rank")))
    keys = static.select(F.col("scope").alias("at"), "route", F.explode(F.concat(F.array(as_path, as_words), as_parts)).alias("k")).select("at", "route", "k.*")
    keys = stored(keys.where("key <> ''"), "routes")
    # For a canonical name a path and its words are one; of equals the smaller route.
    named = keys.groupBy("at", "key").agg(F.min(F.struct(F.greatest("rank", F.lit(1)).alias("rank"), "route")).alias("n"))
    direct = by_group.join(named, (F.col("canonical") == F.col("key")) & F.col("scope").eqNullSafe(F.col("at"))).withColumn("route", F.col("n.route"))
    better = F.min(F.struct((-F.col("score")).alias("s"), "route", (-F.col("strength")).alias("neg"), F.col("own").alias("own"))).alias("b")
    best = direct.groupBy("qid", "scope", "folded", "explained").agg(better)
    best = stored(best.select("qid", "scope", "explained", "b.route", (-F.col("b.neg")).alias("strength"), F.col("b.own").alias("canonical_mentioned"), (-F.col("b.s")).cast("long").alias("score")), "direct")

    missing = by_group.join(best.select(F.col("qid").alias("known")).distinct(), F.col("qid") == F.col("known"), "left_anti")
    any_term = missing.join(terms.select(F.col("scope").alias("in"), F.col("name").alias("of"), "term"), (F.col("name") == F.col("of")) & F.col("scope").eqNullSafe(F.col("in")))
    some = keys.where("rank <> 1").groupBy("at", "key").agg(F.min(F.struct("rank", "route")).alias("n"))
    met = any_term.join(some, (F.col("term") == F.col("key")) & F.col("scope").eqNullSafe(F.col("at")))
    loose = met.groupBy("qid", "scope", "explained").agg(F.min("n").alias("n"))
    length = missing.groupBy(F.col("qid").alias("q")).agg(F.max("strength").alias("strength"))
    loose = loose.join(length, F.col("qid") == F.col("q")).select("qid", "scope", "explained", "n.route", "strength", F.lit(False).alias("canonical_mentioned"), F.lit(None).cast("long").alias("score"))
    return best.unionByName(loose)
