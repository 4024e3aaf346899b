"""Bounded answers composed from the operators: repositories with their links, routes, and evidence for a question.

All inputs are DataFrames, and so are the answers; only the question itself, one string, is handled on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import budget, search


def links(repositories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """consumer, provider, package, kind: repositories (name, package_name) whose package another one depends on."""
    provider = repositories.select(F.col("name").alias("provider"), F.col("package_name").alias("package"))
    uses = dependencies.select(F.col("repository").alias("consumer"), F.col("package_name").alias("package"), "kind")
    return uses.join(provider, "package").where("consumer <> provider").select("consumer", "provider", "package", "kind")


def repository(repositories: DataFrame, dependencies: DataFrame, name: str | None = None) -> DataFrame:
    """name, outgoing, incoming: each repository (or one) with the sorted names it depends on and is used by."""
    all_links = links(repositories, dependencies)
    out = all_links.groupBy(F.col("consumer").alias("name")).agg(F.sort_array(F.collect_set("provider")).alias("outgoing"))
    into = all_links.groupBy(F.col("provider").alias("name")).agg(F.sort_array(F.collect_set("consumer")).alias("incoming"))
    chosen = repositories if name is None else repositories.where(F.col("name") == name)
    none = F.array().cast("array<string>")
    return chosen.join(out, "name", "left").join(into, "name", "left").withColumns({c: F.coalesce(c, none) for c in ("outgoing", "incoming")})


#: What each level of detail shows of a route, each with all of the level before.
DETAIL = {
    "summary": ["repository", "route", "rendering", "source_file"],
    "runtime": ["auth_required", "cache_behavior"],
    "dependencies": ["data_sources", "backend_dependencies"],
    "full": ["layout_chain", "behavior_files"],
}


def route(routes: DataFrame, wanted: str | None = None, detail: str = "summary", limit: int = 50) -> DataFrame:
    """Active routes, or those equal to `wanted` but for case, accents, escapes and slashes at the end."""
    columns: list[str] = []
    for level, names in DETAIL.items():
        columns += [c for c in names if c in routes.columns]
        if level == detail:
            break
    found = routes.where("active")
    if wanted is not None:
        found = found.where(text.route_key(F.col("route")) == text.route_key(F.lit(wanted)))
    return found.select(*columns).orderBy("route", "source_file").limit(limit)


def context(facts: DataFrame, question: str, repository: str | None = None, max_chars: int = 6000, limit: int = 10) -> DataFrame:
    """Evidence for a question: facts (as search.hybrid has them) ranked and cut to a budget.

    The candidates are the BM25 hits of the question's phrases in the chosen facts; the best fact of each entity stays, and
    the longest prefix within max_chars is returned: rank, id, kind, subject, content, source_file, score, used. No fact
    that matches: no row, so the question can't be answered from the facts.
    """
    limit = max(1, min(50, limit))
    chosen = facts if repository is None else facts.where(F.col("repository") == repository)
    asked = search.phrases(question) or [("",)]
    hits = search.bm25(chosen.withColumn("all", F.concat_ws(" ", "kind", "subject", "content")), "id", "all", asked)
    pool = hits.orderBy(F.desc("score"), "doc_id").limit(min(200, max(50, 6 * limit))).select(F.col("doc_id").alias("id"), "score", F.lit("fts").alias("c"))
    channels = search.union_channels(("fts", search.channel_ranks(pool, "c", F.desc("score"), "id")))
    best = search.hybrid(chosen, channels, question, limit).select("id", "score")
    packed = chosen.select("id", "kind", "subject", "content", "source_file").join(best, "id")
    packed = packed.withColumn("pack", F.lit(1)).withColumn("size", F.length("subject") + F.length("content"))
    ranked = search.channel_ranks(packed, "pack", F.desc("score"), "id")
    return budget.prefix_within(ranked, "pack", "rank", "size", max_chars).select("rank", "id", "kind", "subject", "content", "source_file", "score", "used")
