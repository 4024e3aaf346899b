"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role turns, reversible escapes.

A conversation's turns are collected as structs and sorted. Runs of one role in the sorted array are merged into blocks,
`<|role:R|>` text `<|next|>` text ... `<|end|>`, which are concatenated. Inside roles and texts `&`, `<`, `>` become
`&amp;`, `&lt;`, `&gt;`, so no text can hold a mark, and every mark and every turn can be read back. An aggregation over the
blocks sums their lengths to `loss_spans`: where the assistant's texts lie in the formatted string, in code points
[start, end).

Defined results: null text and null role are empty; turns order by (turn, role, text) with null first, so ties and
repeated rows have a fixed place; a null conv_id is a conversation of its own; an empty table gives no rows; other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound

NEXT, END = "<|next|>", "<|end|>"
#: Code points of a chunk when a formatted string is read back.
CHUNK = 4096
#: Elements of an array that are summed in one run.
GROUP = 128


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,end>> of turns (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: ~_role(i).eqNullSafe(_role(i - 1)))  # where a run of one role begins
    blocks = F.transform("opens", lambda at, k: _block(at, F.coalesce(F.get("opens", k + 1), F.size("turns")) - at))
    blocks = collected.withColumn("opens", opens).select("conv_id", blocks.alias("blocks"))
    written = F.transform("blocks", _written)
    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), _spans(loss_role).alias("loss_spans"))


def _role(i: Column) -> Column:
    return F.when(i >= 0, F.get("turns", i)["role"])


def _block(at: Column, n: Column) -> Column:
    """The n turns from `at` on, all of one role, as that role and their texts, escaped."""
    texts = F.transform(F.sequence(at, at + n - 1), lambda i: escaped(F.get("turns", i)["text"]))
    return F.struct(F.concat(F.lit("<|role:"), escaped(_role(at)), F.lit("|>")).alias("head"), _role(at).alias("role"), texts.alias("texts"))


def _written(b: Column) -> Column:
    return F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))


def starts(sizes: Column) -> Column:
    """The sum of all sizes before each one (of an array that is not empty).

    Arrays are copied when they grow, so sums run within groups of GROUP, and then over the groups.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
    add = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list"))

    def within(sizes: Column) -> Column:
        last = lambda g: F.least(F.size(sizes), (g + 1) * GROUP) - 1
        group = lambda g: F.aggregate(F.sequence(g * GROUP, last(g)), zero, lambda a, i: add(a, F.get(sizes, i)))
        return bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int")), group), over)

    def over(groups: Column) -> Column:
        tops = F.aggregate(groups, zero, lambda a, g: add(a, g["at"]), lambda a: a["list"])
        return bound(tops, lambda t: F.flatten(F.transform(groups, lambda g, k: F.transform(g["list"], lambda s: s + F.get(t, k)))))

    return bound(sizes, within)


def _spans(loss_role: str) -> Column:
    """Where the texts of loss_role lie in the joined `blocks`."""

    def of_block(b: Column, begin: Column) -> Column:
        begin = begin + F.length(b["head"])
        at = starts(F.transform(b["texts"], lambda x: F.length(x) + len(NEXT)))
        return F.zip_with(b["texts"], at, lambda x, s: F.struct((begin + s).alias("start"), (begin + s + F.length(x)).alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    each = F.zip_with("blocks", starts(F.transform("blocks", lambda b: F.length(_written(b)))), lambda b, s: F.when(b["role"] == loss_role, of_block(b, s)).otherwise(none))
    return F.flatten(each)


def parse_chat(formatted: DataFrame) -> DataFrame:
    """Reads format_chat's output back: adds turns array<struct<role,text>> and loss_text."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    role = lambda b: unescaped(F.regexp_extract(b, r"^<\|role:([^<>]*)\|>", 1))
    texts = lambda b: F.split(F.regexp_replace(b, r"^<\|role:[^<>]*\|>", ""), r"<\|next\|>")
    read = formatted.withColumn("blocks", F.transform(blocks, lambda b: F.struct(role(b).alias("role"), texts(b).alias("texts"))))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    # A long string is walked from its start for each piece that is cut out, so it is cut into chunks once.
    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(chunks: Column, s: Column) -> Column:
        first = F.floor(s["start"] / CHUNK).cast("int")
        last = F.greatest(first, F.floor((s["end"] - 1) / CHUNK).cast("int"))
        joined = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(chunks, i)), "")
        return F.substring(joined, s["start"] - first * CHUNK + 1, s["end"] - s["start"])

    loss = bound(chunks, lambda c: F.transform("loss_spans", lambda s: unescaped(cut(c, s))))
    return read.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, "")).drop("blocks")
