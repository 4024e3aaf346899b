"""A corpus pipeline of five stages; each calls one operator of lodestrata.llm on all that the stage before kept.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return the columns of documents; each result
is written as Parquet and read again before the next stage.

1. language ID: a model is trained on the labelled documents themselves (text and non-null lang); documents in which no
   language is found (`und`) go, mixed ones stay; lang becomes the language with the largest share.
2. n-gram Jaccard join (five words, 0.8): of each group of near duplicates one row stays, that with the smallest id
   (one without an id only if the whole group has none; of rows with equal id and text any one). Texts that only share a 64-bit hash are told apart by 128 bits.
3. decontamination: documents of which a twentieth or more lies in verbatim benchmark passages of 13 words go.
4. mixing: a document appears as often as the mix takes it (a part taken counts as a whole), so not at all if its source
   is full; documents without words go.
5. token-ID output: sorted-string-table shards, read back as doc_id, start, n_tokens, ids_crc32.

Defined results: an empty table passes through all stages as an empty table. Null and empty texts, and texts without a
letter, have no language and go in stage 1; given to a later stage, they stay in 2 and 3, go in 4, and are the end id alone in
5. Texts of any length are read whole. Ties go to the smaller id, rows of equal id and text count as copies of each other (one
stays in stage 2; where stage 4 gets such rows, each appears as often as the most taken one), and a null id is an id like
others. Stages 2 and 3 judge rows by their own text, also where doc_id is null or repeated. Extra columns of documents, of
any name, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, language, mixing, ngram_join, shared, sstable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    # Columns travel under other names, so none clashes with what identify adds.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = language.identify(docs.select("text", *[F.col(c).alias(n) for c, n in names.items()]), model, *names.values(), keep_text=True)
    back = {c: F.col(names[c]).alias(c) if c in names else F.col("text") for c in docs.columns} | {"lang": F.col("lang_pred").alias("lang")}
    return found.where("lang_pred <> 'und'").select(*[back[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are told by id and text. First one row of each text stays, so that texts have keys of their own without regard to
    # ids; then near copies are joined under these keys. Rows without words are no copies of each other.
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.where(has_words).select(F.col("doc_id").alias("id"), "text")
    shared_keys = _shared_keys(texts)
    key = _key(F.col("text"), shared_keys)
    rows = texts.groupBy("id", key.alias("key")).agg(F.count("*").alias("n"))
    rows = shared.stored(rows, "rows")
    first = shared.stored(rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id")).getField("id").alias("first")), "first")
    copies = rows.join(first, "key").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "key")
    left = docs.join(*_these(docs, copies, "copies", shared_keys), "left_anti")
    twice = rows.where("n > 1").select("id", "key")  # repeated with their id and text
    if not twice.isEmpty():
        these = _these(left, twice, "twice", shared_keys)
        left = left.join(*these, "left_anti").unionByName(left.join(*these, "left_semi").dropDuplicates(["doc_id", "text"]))
    found = ngram_join.ngram_jaccard_components(left.where(has_words).select(key.alias("doc_id"), "text"), n=5, num=80, den=100)
    members = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    members = shared.stored(members.join(first.withColumnRenamed("first", "id"), "key"), "members")
    groups = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"), F.count("*").alias("of")).where("of > 1")
    gone = members.join(groups, "group").where(F.col("key") != F.col("least.key")).select("id", "key")
    return left.join(*_these(left, gone, "gone", shared_keys), "left_anti")


def _key(text: Column, shared_keys: list[list[int]]) -> Column:
    """A 64-bit key of a text: its hash, or a further one where an earlier one is shared by unlike texts."""
    key = _hash(text)
    for seed, keys in enumerate(shared_keys):
        key = F.when(key.isin(keys), _hash(F.lit(seed), text)).otherwise(key)
    return key


def _hash(*values: Column) -> Column:
    return F.xxhash64(*values)


def _shared_keys(texts: DataFrame) -> list[list[int]]:
    """Keys that unlike texts, told apart by 128 bits, share: of n texts n ** 2 / 2 ** 65 are expected (three of 10 ** 10)."""
    out: list[list[int]] = []
    told = shared.stored(texts.select(_key(F.col("text"), out).alias("key"), F.md5("text").alias("md5")).distinct(), "told")
    while twice := [r["key"] for r in told.groupBy("key").count().where("count > 1").select("key").collect()]:
        out.append(twice)
        told = texts.select(_key(F.col("text"), out).alias("key"), F.md5("text").alias("md5")).distinct()
    return out


def _these(docs: DataFrame, rows: DataFrame, name: str, shared_keys: list[list[int]]) -> tuple[DataFrame, Column]:
    """rows (id, key), written, and the condition that joins them with docs; columns of docs may have any names."""
    rows = shared.small(shared.stored(rows, name))
    return rows, docs["doc_id"].eqNullSafe(rows["id"]) & (_key(docs["text"], shared_keys) == rows["key"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix_sources(docs).where("taken > 0").select(F.col("doc_id").alias("mixed_id"), F.ceil(F.col("taken") / F.col("size")).alias("times"))
    # Repeated rows of one id share their copies. What is taken is written: a few bytes a row, broadcast while it is small, so
    # that texts are only exchanged beyond.
    taken = shared.small(shared.stored(taken.groupBy("mixed_id").agg(F.max("times").alias("times")), "taken"))
    copies = docs.join(taken, docs["doc_id"].eqNullSafe(taken["mixed_id"]))
    number = "copy_" + "_".join(docs.columns)  # a name that no column has
    each = F.explode(F.sequence(F.lit(1), taken["times"].cast("int"))).alias(number)
    return copies.select(*[docs[c] for c in docs.columns], each).drop(number)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.token_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", token_output),
]

#: Language mixtures, hash-ordered streams and token files are no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each to the rows that the one before left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return docs
