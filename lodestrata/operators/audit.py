"""Security invariants over a fact table: each passes, fails with findings, or is skipped where there is nothing to check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.storage import small

# Names of keys that hold secrets, and columns whose text may hold a value alone.
SECRET_KEY = r"(?i)(?:SECRET|TOKEN|PASSWORD|PASSWD|PRIVATE|CREDENTIAL|API_?KEY|AUTH)"
PAYLOAD = r"(?i)(?:content|subject|rationale|note|query_text|_json)$"


def is_secret(key: Column, value: Column) -> Column:
    """Whether a value is looked for inside texts: by its key, as a URL, or if it is long and of three kinds of characters."""
    kinds = sum((value.rlike(p).cast("int") for p in ("(?i)[a-z]", "[0-9]", "(?i)[^a-z0-9]")), F.lit(0))
    return key.rlike(SECRET_KEY) | value.rlike("(?i)^[a-z][a-z0-9+.-]*://") | ((F.length(value) >= 16) & (kinds >= 3))


def leaked_values(cells: DataFrame, values: DataFrame) -> DataFrame:
    """key, table of values (key, value of six characters or more) that cells (table, column, text) hold.

    A secret is found inside any cell, other values only as a whole cell that carries prose or JSON. A secret's first six
    characters meet the pieces of six of all texts in an equi-join; what meets is compared whole.
    """
    known = values.where(F.length("value") >= 6).select("key", "value", is_secret(F.col("key"), F.col("value")).alias("secret")).distinct()
    whole = cells.where(F.col("column").rlike(PAYLOAD)).join(known, F.col("text") == F.col("value")).select("key", "table")
    secret = known.where("secret").select("key", "value", F.substring("value", 1, 6).alias("start"))
    pieces = F.regexp_extract_all("text", F.lit("(?s)(?=(.{6}))"), F.lit(1))  # of every place, in one pass
    rows = cells.where(F.length("text") >= 6).select("table", "text", F.xxhash64("text").alias("row"))
    said = rows.select("row", F.explode_outer(F.array_distinct(pieces)).alias("start"))
    met = said.join(small(secret), "start").select("row", "key", "value").distinct()
    inside = rows.join(met, "row").where(F.contains("text", F.col("value"))).select("key", "table")
    return whole.unionByName(inside).distinct()


def _result(name: str, findings: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """invariant, status, n_findings of findings (any rows); skipped if `checked` has no row."""
    n = findings.agg(F.count("*").alias("n_findings"))
    some = F.lit(True) if checked is None else F.col("some")
    n = n if checked is None else n.join(checked.limit(1).agg((F.count("*") > 0).alias("some")))
    status = F.when(~some, "skipped").when(F.col("n_findings") > 0, "fail").otherwise("pass")
    return n.select(F.lit(name).alias("invariant"), status.alias("status"), F.when(some, F.col("n_findings")).otherwise(0).alias("n_findings"))


def invariants(facts: DataFrame, evidence: DataFrame, repositories: DataFrame, registry: DataFrame, telemetry: DataFrame, env_values: DataFrame, keep_events: int, keep_days: int, now: Column) -> DataFrame:
    """invariant, status, n_findings of the five invariants.

    facts: id, repository, content, active, producer, quality, confidence, updated_at; evidence: fact_id, file; repositories,
    registry: name; telemetry: text; env_values: key, value.
    """
    active = facts.where("active")
    cells = reduce(
        DataFrame.unionByName,
        [facts.select(F.lit("facts").alias("table"), F.lit("content").alias("column"), F.col("content").alias("text")), telemetry.select(F.lit("telemetry").alias("table"), F.lit("note").alias("column"), "text")],
    )
    located = evidence.join(active.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    outside = located.where("file like '/%' or file like '..%' or file like 'node_modules/%'").select(F.col("file").alias("what")).distinct()
    unknown = repositories.select(F.col("name").alias("what")).join(registry.select(F.col("name").alias("what")), "what", "left_anti")
    made = active.where("producer <> 'deterministic'")
    unlabelled = made.where("quality is null or confidence is null or confidence <> 'inferred'").select("id")
    unfounded = made.join(evidence.select(F.col("fact_id").alias("id")), "id", "left_anti").select("id")
    bodies = active.where(F.length("content") >= 40).select("content").distinct()
    told = telemetry.join(bodies, F.col("text") == F.col("content")).select("content")
    parts = telemetry.select(F.explode(F.split("text", r"[\t\n|]")).alias("content")).join(bodies, "content").select("content")
    too_many = telemetry.agg(F.count("*").alias("n")).where(F.col("n") > keep_events).select("n")
    old = facts.where(~F.col("active") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(keep_days)))).agg(F.count("*").alias("n")).where("n > 0")
    return reduce(
        DataFrame.unionByName,
        [
            _result("I1-no-env-values", leaked_values(cells, env_values), env_values.where(F.length("value") >= 6)),
            _result("I2-paths-inside-registry", outside.unionByName(unknown)),
            _result("I3-made-facts-labelled", unlabelled.unionByName(unfounded).distinct()),
            _result("I4-telemetry-without-content", told.unionByName(parts).distinct(), telemetry),
            _result("I5-retention", too_many.unionByName(old)),
        ],
    )
