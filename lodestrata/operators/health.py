"""Operational analytics: freshness, service levels, misses, gates, audits, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.storage import small


def level(value: Column, target: float, breach: float) -> Column:
    """met up to target, breach from breach on, warn between; unknown for null."""
    return F.when(value.isNull(), "unknown").when(value <= target, "met").when(value >= breach, "breach").otherwise("warn")


def worst(*levels: Column) -> Column:
    """The worst of several levels."""
    order = ("breach", "warn", "unknown", "met")
    out = None
    for name in order:
        any_is = levels[0] == name
        for x in levels[1:]:
            any_is = any_is | (x == name)
        out = F.when(any_is, name) if out is None else out.when(any_is, name)
    return out


def freshness_state(indexed: Column, known: Column, diverged: Column, behind: Column, dirty: Column) -> Column:
    return (
        F.when(indexed.isNull(), "never-indexed").when(~known, "unknown").when(diverged, "diverged").when(behind > 0, "behind").when(dirty, "tree-dirty").otherwise("fresh")
    )


def gate(checks: DataFrame) -> DataFrame:
    """name rows (name, value, threshold, at_least) -> decision: open, blocked or insufficient-evidence, with the failed checks."""
    passed = F.when(F.col("at_least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    judged = checks.withColumn("passed", passed)
    return judged.agg(
        F.when(F.bool_or(F.col("value").isNull()), "insufficient-evidence").when(F.bool_and("passed"), "open").otherwise("blocked").alias("decision"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name"))))).alias("failed"),
    )


def recall(expected: DataFrame, payloads: DataFrame, text: str) -> DataFrame:
    """case_id, n_expected, n_found, recall: which expected strings (case_id, needle) a case's payload holds."""
    joined = expected.join(payloads, "case_id", "left")
    found = F.coalesce(F.contains(F.col(text), F.col("needle")), F.lit(False))
    out = joined.groupBy("case_id").agg(F.count("*").alias("n_expected"), F.count_if(found).alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_expected"), 4))


def token_recall(expected: DataFrame, payloads: DataFrame, case: str, tokens: str) -> DataFrame:
    """case, n_expected, n_found, recall: which of the expected tokens (needle) the payloads of each case hold together."""
    needles = expected.select("needle").distinct()
    said = payloads.select(case, F.explode(F.array_distinct(tokens)).alias("needle")).join(small(needles), "needle").distinct()
    found = said.groupBy(F.col(case).alias("_case")).agg(F.count("*").alias("n_found"))
    cases = payloads.select(case).distinct().join(needles.agg(F.count("*").alias("n_expected")))
    out = cases.join(found, F.col(case).eqNullSafe(F.col("_case")), "left").select(case, "n_expected", F.coalesce("n_found", F.lit(0)).alias("n_found"))
    return out.withColumn("recall", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.round(F.col("n_found") / F.col("n_expected"), 4)))


def ledger(cases: DataFrame) -> DataFrame:
    """Adds nominal and effective saving to cases (baseline, engine, clean): a case that is not clean costs the engine's share on top."""
    nominal = F.col("baseline") - F.col("engine")
    return cases.withColumn("nominal", nominal).withColumn("effective", F.when(F.col("clean"), nominal).otherwise(-F.col("engine")))
