"""Retrieval operators: inverted index and BM25, exact vector search, channel union, ranking and deduplication."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.functions.arrays import bound
from lodestrata.functions.text import camel_split, config_anchors, hit_ratio, plain, qualified_anchors, route_anchor, route_key, terms, tokens
from lodestrata.sources.storage import small, stored

# BM25's parameters and floor, and the weights of the ranking features (their sum is 1).
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {
    "task_fit": 0.20,
    "query_relevance": 0.25,
    "relation_coverage": 0.18,
    "freshness": 0.12,
    "evidence_quality": 0.15,
    "entity_specificity": 0.05,
    "channel_relevance": 0.05,
}


# Fixed value: how long a mentioned alias has to be for its route to count as named.
ALIAS_STRENGTH = 6

# Kinds of facts that answer a question of an intent best.
PREFERRED = {
    "lookup": "repository_profile rendering configuration next_config special_file dependency api_dependency build seo",
    "explain-flow": "server_function api_dependency data_fetching schema_contract module_contract cache cache_invalidation authorization analytics_event rendering configuration",
    "impact": "server_function module_contract schema_contract next_config configuration dependency api_dependency rendering shared_package design_system",
    "debug": "error_handling server_function module_contract schema_contract api_dependency configuration authorization security cache cache_invalidation rendering",
    "implementation-plan": "server_function module_contract schema_contract business_rule api_dependency authorization rendering cache cache_invalidation next_config build design_system",
    "change-review": "technical_debt server_function schema_contract analytics_event rendering api_dependency next_config configuration build",
    "verify": "build error_handling technical_debt",
}

def phrases(question: str, aliases: Sequence[str] = (), most: int = 12) -> list[tuple[str, ...]]:
    """A question's search phrases: its words of two characters or more, and aliases, each as the tokens it holds.

    A word with marks inside (`/cart/[id]`, `next-auth`) is a phrase: its tokens count only one after another.
    """
    said = [w for w in re.findall(r"[\w@./:-]+", question) if len(w) >= 2][:most] + list(aliases)[:most]
    found = (tuple(re.findall(r"[^\W_]+", plain(w))) for w in said)
    return sorted({p for p in found if p})


def _hits(tokens_: Column, wanted: Sequence[tuple[str, ...]]) -> Column:
    """The wanted phrases as often as a list of tokens holds them."""
    single = [p[0] for p in wanted if len(p) == 1]

    def places(listed: Column, phrase: tuple[str, ...]) -> Column:
        begins = lambda i: reduce(lambda x, k: x & F.get(listed, i + k).eqNullSafe(F.lit(phrase[k])), range(1, len(phrase)), F.get(listed, i) == phrase[0])
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(listed) - len(phrase), F.lit(0))), begins)

    def of(listed: Column) -> Column:
        found = [F.filter(listed, lambda t: t.isin(*single))] if single else []
        found += [F.array_repeat(F.lit(" ".join(p)), F.size(places(listed, p))) for p in wanted if len(p) > 1]
        return F.concat(*found) if found else F.array().cast("array<string>")

    return bound(tokens_, of)


def bm25(docs: DataFrame, doc_id: str, text: str, query: Sequence[str | tuple[str, ...]]) -> DataFrame:
    """doc_id, score: BM25 of the distinct query terms or phrases (tuples of tokens); larger is better.

    One scan reads the texts; what it keeps, each document's length and its hits, is written and read for counts and scores.
    """
    wanted = sorted({(q,) if isinstance(q, str) else q for q in query})
    listed = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    narrow = stored(listed.select("doc_id", F.size("_t").alias("dl"), _hits(F.col("_t"), wanted).alias("hits")), "hits")
    found = narrow.select("doc_id", "dl", F.explode("hits").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))
    return scored(found, narrow.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def scored(found: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, score of postings (doc_id, term, dl, tf) of query terms; stats: one row, documents (n) and their mean length (avgdl)."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weights = df.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.sum(F.col("idf") * tf).alias("score"))


def phrase_match(docs: DataFrame, doc_id: str, text: str, phrase: Sequence[str]) -> DataFrame:
    """doc_id of the documents that hold the tokens of phrase one after another."""
    listed = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return listed.where(F.size(_hits(F.col("t"), [tuple(phrase)])) > 0).select("doc_id")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_from_l2(distance: Column) -> Column:
    """Cosine of unit vectors from their distance, within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def knn(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest vectors (all columns and distance); `where` filters before the search, so k rows are found among its rows."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", l2(F.col("embedding"), q)).orderBy("distance", "vec_id").limit(k)


def union_channels(*channels: tuple[str, DataFrame]) -> DataFrame:
    """id, channels (sorted), best_rank, ranks (channel -> rank) of hits (id, rank) of several channels."""
    hits = None
    for name, df in channels:
        one = df.select("id", "rank").withColumn("channel", F.lit(name))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("id", "channel").agg(F.min("rank").alias("rank"))
    return best.groupBy("id").agg(
        F.sort_array(F.collect_list("channel")).alias("channels"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
    )


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def evidence_quality(confidence: Column, quality: Column, has_evidence: Column, located: Column, is_env: Column) -> Column:
    """A fact's own quality as it is given; else one by its confidence, more with evidence and with a place, less from an env file."""
    base = F.when(confidence.isin("verified", "observed"), 0.55).when(confidence == "derived", 0.45).when(confidence == "inferred", 0.25).otherwise(0.35)
    extra = F.when(has_evidence, 0.2).otherwise(0.0) + F.when(located, 0.2).otherwise(0.0) - F.when(is_env, 0.35).otherwise(0.0)
    return clamp(F.coalesce(quality, base + extra))


def task_fit(kind: Column, intent: Column, exact: Column, boosted: Column) -> Column:
    """How well a kind of fact fits a question's intent: 1 for an exact anchor; kinds that the question names weigh more."""
    fits = F.coalesce(*[F.when((intent == i) & kind.isin(*kinds.split()), F.lit(True)) for i, kinds in PREFERRED.items()], F.lit(False))
    base = F.when(fits, 0.8).when(intent == "unknown", 0.25).when(kind.isin("business_capability", "performance_observation"), 0.3).otherwise(0.55)
    return F.when(exact, 1.0).otherwise(clamp(base + F.when(boosted, 0.2).otherwise(0.0)))


def entity_specificity(entity: Column, subject: Column) -> Column:
    """1 for routes, configuration keys and symbols, less for files, least for other names."""
    named = F.contains(entity, F.lit(":route:")) | F.contains(entity, F.lit(":config:")) | F.contains(subject, F.lit("#"))
    return F.when(named, 1.0).when(subject.rlike(r"\.[cm]?[jt]sx?(?::\d+)?$"), 0.8).otherwise(0.6)


def freshness(sha: Column, current: Column) -> Column:
    return F.when(sha.isNull() | current.isNull(), 0.5).when(sha == current, 1.0).otherwise(0.2)


def score(features: dict[str, Column]) -> Column:
    """The weighted sum of all features."""
    if missing := WEIGHTS.keys() - features.keys():
        raise ValueError(f"no value for {', '.join(sorted(missing))}")
    return sum((F.lit(w) * features[name] for name, w in WEIGHTS.items()), F.lit(0.0))


def entity_key(repository: Column, kind: Column, subject: Column) -> Column:
    """What one entity of a repository is called whatever fact names it: configuration keys, routes, or the fact's kind and subject.

    Parts that are null are empty.
    """
    kind, subject = F.coalesce(kind, F.lit("")), F.coalesce(subject, F.lit(""))
    name = F.regexp_replace(F.trim(F.regexp_replace(F.trim(subject), r":\d+$", " ")), r"\s+", " ")
    is_config = (kind == "configuration") | ((kind == "dependency") & name.rlike("(?i)^config:"))
    own = (
        F.when(is_config, F.concat(F.lit("config:"), F.regexp_replace(name, "(?i)^config:", "")))
        .when(name.rlike("(?i)^route:"), F.concat(F.lit("route:"), F.substring(name, 7, 1_000_000)))
        .otherwise(F.concat(kind, F.lit(":"), name))
    )
    return F.concat(F.coalesce(repository, F.lit("")), F.lit(":"), own)


def rank_dedupe(hits: DataFrame, key: str, score: str, id: str, limit: int) -> DataFrame:
    """The best hit of each entity with the number of others, best first."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(id)).alias("neg"))).alias("best")
    grouped = hits.groupBy(key).agg(best, (F.count("*") - 1).alias("n_duplicates"))
    return grouped.select(key, (-F.col("best.neg")).alias(id), F.col("best.s").alias(score), "n_duplicates").orderBy(F.desc(score), key).limit(limit)


def relevance(wanted: Column, subject: Column, source_file: Column, content: Column) -> Column:
    """Three parts the share of wanted terms in subject and file, one part that in the first 600 letters of the content."""
    split = lambda c: tokens(camel_split(F.coalesce(c, F.lit(""))))
    # Both lists are computed once and not anew for each wanted term.
    share = lambda listed: bound(listed, lambda given: hit_ratio(wanted, given))
    own, told = F.concat(split(subject), split(source_file)), split(F.substring(content, 1, 600))
    return F.when(F.size(wanted) == 0, 0.5).otherwise(clamp(0.75 * share(own) + 0.25 * share(told)))


def hybrid(facts: DataFrame, hits: DataFrame, question: str, limit: int = 10, types: Sequence[str] = (), aliased: tuple[str, int] | None = None) -> DataFrame:
    """entity, id, score, n_duplicates, channels: the best facts for a question among the hits of all channels.

    facts: id, repository, kind, subject, content, source_file, commit_sha, repository_sha, confidence, quality, n_evidence,
    n_located; hits: as union_channels gives them, few rows, which is checked before they are broadcast to the facts. Given
    types filter; kinds that the question names only weigh more. A fact that the question names exactly fits fully. The best
    rank that any channel gave any fact of an entity counts for all of its facts. aliased: the route that the question's aliases
    stand for and their strength (see aliases.route_matches), which is as exact as a route in the question if it is strong.
    """
    asked = F.lit(question)
    intent, named = rules.intent(asked)["intent"], rules.memory_types(asked)
    wanted, route = terms(asked), route_anchor(asked)
    if aliased is not None and aliased[1] >= ALIAS_STRENGTH:
        route = F.coalesce(route, F.lit(aliased[0]))
    files, symbols = qualified_anchors(asked)
    chosen = facts.where(F.col("kind").isin(*types)) if types else facts
    rows = chosen.join(small(stored(hits, "hits")), "id").withColumn("entity", entity_key(F.col("repository"), F.col("kind"), F.col("subject")))
    subject, is_route = F.col("subject"), F.col("subject").startswith("route:")
    exact = (
        F.coalesce(is_route & (route_key(F.substring("subject", 7, 1_000_000)) == route_key(route)), F.lit(False))
        | F.exists(config_anchors(asked), lambda a: F.endswith(F.col("entity"), F.concat(F.lit(":config:"), a)))
        | F.exists(files, lambda a: F.coalesce((F.col("source_file") == a) | subject.startswith(a), F.lit(False)))
        | F.array_contains(symbols, subject)
    )
    is_env = F.coalesce(F.col("source_file").rlike(r"(?:^|/)\.env(?:\.|$)"), F.lit(False))
    features = {
        "task_fit": task_fit(F.col("kind"), intent, exact, F.lit(False) if types else F.array_contains(named, F.col("kind"))),
        "query_relevance": relevance(wanted, subject, F.col("source_file"), F.col("content")),
        "relation_coverage": F.coalesce(F.col("relation_coverage"), F.lit(0.2)) if "relation_coverage" in facts.columns else F.lit(0.2),
        "freshness": freshness(F.col("commit_sha"), F.col("repository_sha")),
        "evidence_quality": evidence_quality(F.coalesce("confidence", F.lit("")), F.col("quality"), (F.col("n_evidence") > 0) | F.col("source_file").isNotNull(), F.col("n_located") > 0, is_env),
        "entity_specificity": entity_specificity(F.col("entity"), subject),
        "channel_relevance": F.lit(0.0),
    }
    # Texts are read once: what is known of a fact but for its entity's rank is written, a few values a hit.
    known = stored(rows.select("entity", "id", "channels", "best_rank", score(features).alias("own")), "ranked")
    best = known.groupBy("entity").agg(F.min("best_rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("all"))
    full = F.round(F.col("own") + WEIGHTS["channel_relevance"] / F.col("rank"), 6)
    top = rank_dedupe(known.join(best, "entity").withColumn("score", full), "entity", "score", "id", max(1, min(50, limit)))
    named = top.join(best.select("entity", F.array_join("all", ",").alias("channels")), "entity")
    return named.orderBy(F.desc("score"), "entity")  # a join keeps no order


def channel_ranks(hits: DataFrame, channel: str, *order: Column | str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(channel).orderBy(*order)))
