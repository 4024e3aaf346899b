"""What changed between two listings of files with their texts: added, removed, modified, and renamed with how alike they are.

Files of equal content under other names are renamed first, one to one in the order of their paths, also if a content occurs many
times. What is left is compared by lines: two files are as alike as the bytes of the lines that they share (as often as both have
them) are of the larger one, from one half on. Contents, not files, are compared, so copies cost nothing.

Pairs come from an inverted index of line hashes. Lines are ordered by the number of contents that hold them, rarest first; two
contents that share half of either share a line among each one's first lines that make up half of it, so only those are
indexed. A line that many files hold (a brace, a license) is among them only in files that have nothing rarer in half of their
bytes; the join's cost is the pairs that share one of these lines, and no pair from one half on is missed.

Matching is greedy, most alike first, then by paths, one to one, in rounds: a pair that is the best one for both its sides is taken,
which gives what taking one pair after another would.

Defined results: null texts are empty, and empty files are only renamed to empty ones; rows with a null path are left out; a path
given twice counts with its smallest text; empty tables give no rows or only added or removed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.relational import numbered
from lodestrata.sources.storage import stored

_OUT = ("status", "path", "previous_path", "score")


def _files(files: DataFrame) -> DataFrame:
    rows = files.where("path is not null").groupBy("path").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return stored(rows.withColumn("hash", F.unhex(F.sha2("text", 256))), "files")


def _lines(contents: DataFrame) -> DataFrame:
    """hash, line, n, weight of the different lines of contents (hash, text); weight: bytes of one of them with its end."""
    each = contents.select("hash", F.explode(F.split("text", "\n")).alias("said"))
    line = F.unhex(F.md5("said")).alias("line")
    return each.groupBy("hash", line, (F.octet_length("said") + 1).cast("long").alias("weight")).agg(F.count("*").alias("n"))


def _first_lines(lines: DataFrame, order: DataFrame) -> DataFrame:
    """hash, line: rarest lines first, up to half of a content's bytes."""
    mine = Window.partitionBy("hash")
    before = mine.orderBy("spread", "line").rowsBetween(Window.unboundedPreceding, -1)
    bytes_ = F.col("n") * F.col("weight")
    rows = lines.join(order, "line").withColumn("before", F.coalesce(F.sum(bytes_).over(before), F.lit(0))).withColumn("size", F.sum(bytes_).over(mine))
    return rows.where("2 * before <= size").select("hash", "line")


def alike(gone: DataFrame, new: DataFrame) -> DataFrame:
    """a, b, score of contents (hash, text) of gone and new files of which the larger one's half or more is shared; score: percent."""
    left, right = stored(_lines(gone), "lines"), stored(_lines(new), "lines")
    order = left.select("line", "hash").union(right.select("line", "hash")).groupBy("line").agg(F.count("*").alias("spread"))
    order = stored(order, "order")
    firsts = _first_lines(left, order).withColumnRenamed("hash", "a").join(_first_lines(right, order).withColumnRenamed("hash", "b"), "line")
    pairs = stored(firsts.select("a", "b").distinct(), "pairs")
    size = lambda lines, c: lines.groupBy(F.col("hash").alias(c)).agg(F.sum(F.col("n") * F.col("weight")).alias(f"size_{c}"))
    ours = pairs.join(left.select(F.col("hash").alias("a"), "line", "weight", F.col("n").alias("n_a")), "a")
    both = ours.join(right.select(F.col("hash").alias("b"), "line", F.col("n").alias("n_b")), ["b", "line"])
    shared = both.groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b") * F.col("weight")).alias("shared"))
    whole = shared.join(size(left, "a"), "a").join(size(right, "b"), "b").withColumn("most", F.greatest("size_a", "size_b"))
    return whole.where("2 * shared >= most").select("a", "b", F.expr("100 * shared div most").alias("score"))


def _matched(pairs: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """a, b, score, skip_a, skip_b, n: which pairs of contents are taken, for how many files, after how many of each.

    gone: a, name (the smallest path), n files; new: b, name, n.
    """
    left = lambda df, c: df.select(c, F.col("name").alias(f"name_{c}"), F.col("n").alias(f"n_{c}"))
    a, b = left(gone, "a").withColumn("skip_a", F.lit(0).cast("long")), left(new, "b").withColumn("skip_b", F.lit(0).cast("long"))
    here, out = stored(pairs.join(a, "a").join(b, "b"), "open"), None
    while not here.isEmpty():
        rank = F.struct((-F.col("score")).alias("s"), "name_a", "name_b", "a", "b")
        best = lambda c: here.groupBy(c).agg(F.min(rank).alias("r")).select("r.a", "r.b")  # noqa: B023,E731
        taken = best("a").intersect(best("b"))
        n = F.least(F.col("n_a") - F.col("skip_a"), F.col("n_b") - F.col("skip_b"))
        taken = stored(here.join(taken, ["a", "b"]).withColumn("n", n).select("a", "b", "score", "skip_a", "skip_b", "n"), "taken")
        out = taken if out is None else out.unionByName(taken)
        used = lambda c: taken.select(c, F.col("n").alias(f"used_{c}"))  # noqa: B023,E731
        rest = here.join(taken.select("a", "b"), ["a", "b"], "left_anti").join(used("a"), "a", "left").join(used("b"), "b", "left")
        rest = rest.withColumns({f"skip_{c}": F.col(f"skip_{c}") + F.coalesce(f"used_{c}", F.lit(0)) for c in "ab"}).drop("used_a", "used_b")
        here = stored(rest.where("skip_a < n_a and skip_b < n_b"), "open")
    return out if out is not None else pairs.selectExpr("a", "b", "score", "0L as skip_a", "0L as skip_b", "0L as n").limit(0)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """status (A, D, M, R), path, previous_path, score between two listings (path, text)."""
    old, fresh = _files(before), _files(after)
    both = old.select("path", F.col("hash").alias("was")).join(fresh.select("path", F.col("hash").alias("is")), "path", "full")
    both = stored(both, "both")
    modified = both.where("was <> is").select(F.lit("M").alias("status"), "path", F.lit(None).cast("string").alias("previous_path"), F.lit(None).cast("long").alias("score"))
    gone = numbered(both.where("is is null").select("path", F.col("was").alias("hash")), ["hash"], "path")
    new = numbered(both.where("was is null").select("path", F.col("is").alias("hash")), ["hash"], "path")
    same = stored(gone.withColumnRenamed("path", "previous_path").join(new, ["hash", "at"]).select("path", "previous_path", "hash"), "same")
    exact = same.select(F.lit("R").alias("status"), "path", "previous_path", F.lit(100).cast("long").alias("score"))
    rest = lambda df, c: stored(numbered(df.drop("at").join(same.select(F.col(c).alias("path")), "path", "left_anti"), ["hash"], "path"), "rest")
    gone, new = rest(gone, "previous_path"), rest(new, "path")
    texts = lambda files, some: files.join(some.where("at = 1").select("path"), "path", "left_semi").where("text <> ''").select("hash", "text")
    pairs = stored(alike(texts(old, gone), texts(fresh, new)), "alike")
    classes = lambda df, c: df.groupBy(F.col("hash").alias(c)).agg(F.min("path").alias("name"), F.count("*").alias("n"))
    taken = _matched(pairs, classes(gone, "a"), classes(new, "b"))
    # The files of a content go in the order of their paths.
    ours = gone.select(F.col("hash").alias("a"), F.col("path").alias("previous_path"), F.col("at").alias("at_a"))
    theirs = new.select(F.col("hash").alias("b"), "path", F.col("at").alias("at_b"))
    mine = taken.join(ours, "a").where("at_a > skip_a and at_a <= skip_a + n").withColumn("at_b", F.col("at_a") - F.col("skip_a") + F.col("skip_b"))
    similar = stored(mine.join(theirs, ["b", "at_b"]).select(F.lit("R").alias("status"), "path", "previous_path", "score"), "similar")
    none = F.lit(None).cast("string"), F.lit(None).cast("long")
    added = new.join(similar.select("path"), "path", "left_anti").select(F.lit("A").alias("status"), "path", none[0].alias("previous_path"), none[1].alias("score"))
    lost = gone.join(similar.select(F.col("previous_path").alias("path")), "path", "left_anti").select(F.lit("D").alias("status"), "path", none[0].alias("previous_path"), none[1].alias("score"))
    return modified.unionByName(exact).unionByName(similar).unionByName(added).unionByName(lost).select(*_OUT)
