r"""Quality rules as weak supervision (DataFrame functions only).

Each rule votes good (1), bad (0) or abstains (-1). The rows are counted by vote pattern - at most 3 ** len(RULES)
patterns, whatever the corpus - and expectation-maximisation over these counts estimates how each rule votes on good and
on several kinds of bad documents. The posterior of being good follows from a document's votes alone, is joined to it
by its pattern, and replaces "all rules must pass".

Defined results: null text has no words and counts 0 everywhere; empty text too; repeated rows are scored alike; an empty
table gives no rows; columns other than doc_id and text are dropped. Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound, stored

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: EM ends when no posterior changes by more than this.
TOLERANCE = 1e-6

#: name: (feature, side that is bad, bad from here on, good on this side of here or never); a rule abstains otherwise.
#: Every kind of junk is seen by two rules or more, as EM learns a rule's accuracy from its agreement with others.
RULES: dict[str, tuple[str, str, float, float | None]] = {
    "length": ("n_words", "low", 50, 80),
    "repetition": ("repeat_share", "high", 0.5, None),
    "lines": ("dup_line_share", "high", 0.5, None),
    "symbols": ("symbol_share", "high", 0.2, None),
    "symbol_density": ("symbol_density", "high", 0.04, None),
    "pipes": ("pipe_share", "high", 0.1, None),
    "word_length_low": ("mean_word", "low", 2.0, 3.0),
    "word_length_high": ("mean_word", "high", 14.0, 11.0),
    "capitals": ("upper_share", "high", 0.5, None),
    "shouting": ("shout_share", "high", 0.3, None),
    "digits": ("digit_share", "high", 0.3, None),
}


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", text.alias("t")).withColumn("w", F.array_remove(F.split("t", SEPARATORS), ""))
    n = F.size("w")
    with_word = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    t = t.withColumn("lines", with_word).select(
        "doc_id",
        "w",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_shouts"),
        count(r"\|").alias("n_pipes"),
        count("[0-9]").alias("n_digits"),
    )
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("h", windows)
    # Most texts repeat no window; only where there are fewer different ones is it looked up which.
    repeated = F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(0)
    return t.withColumn("n_repeat_words", repeated).drop("w", "h")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more.

    Sorted by hash, equal windows are neighbours; their positions in text order then tell which words they cover.
    """

    def positions(s: Column) -> Column:
        twice = lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))

    def words(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return bound(F.sort_array(placed), lambda s: bound(positions(s), words))


def _measure(name: str) -> Column:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "symbol_share": F.col("n_symbols") / n,
        "symbol_density": F.col("n_symbols") / chars,
        "pipe_share": F.col("n_pipes") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "mean_word": F.col("word_chars") / n,
        "upper_share": F.col("n_upper") / chars,
        "shout_share": F.col("n_shouts") / n,
        "digit_share": F.col("n_digits") / chars,
    }[name]


def votes() -> Column:
    """The rules' votes as an array of 1, 0 and -1 in the order of RULES."""
    out = []
    for feature, side, bad, good in RULES.values():
        x = _measure(feature)
        is_bad = x >= bad if side == "high" else x < bad
        vote = F.when(is_bad, 0)
        if good is not None:
            vote = vote.when(x < good if side == "high" else x >= good, 1)
        out.append(vote.otherwise(-1).cast("int"))
    return F.array(*out)


def learn(patterns: list[tuple[int, ...]], counts: list[int], tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: each pattern's posterior of being good, and each rule's accuracy.

    Documents are good, or bad in one of as many ways as there are rules: the classes start with good documents that few
    rules call bad, and for each rule a rare class that it finds and others often miss. EM then learns from co-occurring
    votes how each rule votes on each class, until the posteriors stay within `tolerance`. A rule's accuracy is the share of its bad votes that fall on bad classes.
    All probabilities have small pseudo-counts, so an empty or one-sided corpus keeps finite odds.
    """
    k = len(RULES)
    votes = np.array(patterns, int).reshape(-1, k)
    n = np.array(counts, float)
    seen = np.stack([votes == 1, votes == 0, votes == -1], 2).astype(float)  # pattern, rule, vote
    table = np.tile(np.array([0.6, 0.15, 0.25]), (k + 1, k, 1))  # class, rule, vote
    table[0] = [0.8, 0.02, 0.18]
    table[np.arange(1, k + 1), np.arange(k)] = [0.1, 0.8, 0.1]
    prior = np.r_[0.8, np.full(k, 0.2 / k)]
    belongs = np.zeros((len(n), k + 1))
    changed = np.inf if len(n) else 0.0
    while changed > tolerance:
        before = belongs
        odds = np.log(prior) + np.einsum("prv,crv->pc", seen, np.log(table))
        belongs = np.exp(odds - odds.max(1, keepdims=True, initial=-1e9))
        belongs /= belongs.sum(1, keepdims=True)
        changed = np.abs(belongs - before).max()
        mass = belongs * n[:, None]
        size = mass.sum(0)
        prior = (size + 0.1) / (size.sum() + 0.1 * (k + 1))
        table = (np.einsum("pc,prv->crv", mass, seen) + 0.1 * np.array([0.6, 0.15, 0.25])) / (size + 0.1)[:, None, None]
    fired = seen[:, :, 1] * n[:, None]
    accuracy = (fired * (1 - belongs[:, :1])).sum(0) / np.maximum(fired.sum(0), 1)
    return belongs[:, 0], accuracy


def quality(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept."""
    measured = stored(features(docs).withColumn("votes", votes()), "quality")
    found = measured.groupBy("votes").count().collect()  # bounded, see above
    p_good, _ = learn([tuple(r["votes"]) for r in found], [r["count"] for r in found])
    rows = [(list(r["votes"]), float(p)) for r, p in zip(found, p_good, strict=True)]
    judged = measured.join(F.broadcast(docs.sparkSession.createDataFrame(rows, "votes array<int>, p_good double")), "votes", "left")
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *[F.col(c).cast("long").alias(c) for c in longs], failed.alias("base_failed"), "p_good").withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)
    )
