"""The registered queries of this subpackage: each applies one operator to its whole table and digests the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import chat, decontamination, html_text, language, merkle, mixing, ngram_join, prefix_trie, quality, secrets, sentencepieces, sharding, sql, sstable

SHARDS = 8


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_docs(spark, sf_dir), n=4, num=85, den=100)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["length"])), F.lit(0)).alias("longest_match"),
    )


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.linked_spans(_docs(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(number, secrets.BASE),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest("spans").alias("spans"),
    )


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(_docs(spark, sf_dir), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("held_out", language.fold() == 1)
    model = language.train(docs.where("not held_out"))
    found = language.identify(docs, model, "doc_id", "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score", F.to_json("langs").alias("langs"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = chat.parse_chat(chat.format_chat(rows.unionByName(more)))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(_docs(spark, sf_dir))
    proof = F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepieces.decode_pieces(sentencepieces.encode_pieces(_docs(spark, sf_dir), path, "doc_id"), path)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_sequences(conversations))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN prev IS DISTINCT FROM role THEN 16 + length(r) ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)
), r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.label FROM r JOIN l ON l.x = r.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

OP2_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), b AS (
  SELECT id AS item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM words WHERE kind = 'b' AND len(w) > 0
), bw AS (SELECT item_id, n, j, array_to_string(w[j:j+n-1], ' ') AS g FROM b
), d AS (SELECT id AS doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM b) WHERE kind = 'd'
), hit AS (SELECT doc_id, i, j, d.n, item_id FROM d JOIN bw ON bw.n = d.n AND bw.g = array_to_string(w[i:i+d.n-1], ' ')
), cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1
), runs AS (SELECT doc_id, item_id, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM hit
), longest AS (SELECT doc_id, max(len) AS longest_match FROM (SELECT doc_id, max(n) + count(*) - 1 AS len FROM runs GROUP BY doc_id, item_id, diagonal, run) GROUP BY 1)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest_match, 0) AS longest_match
FROM words LEFT JOIN cover ON cover.doc_id = id LEFT JOIN items ON items.doc_id = id LEFT JOIN longest ON longest.doc_id = id WHERE kind = 'd'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(named, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1_SQL,
        "op2_decontaminate": OP2_SQL,
        "op3_linked_secrets": sql.OP3,
        "op7_byte_shards": sql.OP7,
        "op9_chat_format": OP9_SQL,
        "op11_merkle_manifest": sql.OP11,
        "op13_prefix_trie": sql.OP13,
    }
