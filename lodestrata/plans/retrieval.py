"""Retrieval: text, BM25, vectors, ranking. Documents stand for facts, embeddings for their vectors, conversations for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import rules, text
from lodestrata.operators import aliases, budget, projection, relational, search, textindex, vectorcells
from lodestrata.plans import query
from lodestrata.sources.storage import shared_dir
from lodestrata.sources.tables import Tables

QUERY = ("the", "license", "thing", "worthless", "released")
_TERMS = ", ".join(f"('{x}')" for x in QUERY)

_BM25 = f"""tok AS (SELECT doc_id, source, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
  stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
  q(term) AS (VALUES {_TERMS}),
  post AS (SELECT doc_id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
  df AS (SELECT term, count(*) AS df FROM post WHERE tf > 0 GROUP BY 1),
  bm AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM post JOIN df USING (term), stat WHERE tf > 0 GROUP BY 1)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_topk(t: Tables) -> DataFrame:
    scored = search.bm25(t.documents, "doc_id", "text", QUERY).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def fts_index_topk(t: Tables) -> DataFrame:
    # Every other document is in the first segment, some with another text; what changed and what is new comes by an update.
    docs = t.documents.select("doc_id", "text")
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "index")
    early = docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.lit("the license of another thing")).otherwise(F.col("text")))
    textindex.update(spark, path, early, None, "doc_id", "text")
    textindex.update(spark, path, docs.where("doc_id % 2 <> 0 or doc_id % 6 = 0"), None, "doc_id", "text")
    return textindex.bm25(spark, path, QUERY).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(strip_accents(text)), '(^|[^\\p{L}\\p{N}])mit[^\\p{L}\\p{N}]+license([^\\p{L}\\p{N}]|$)')")
def fts_phrase(t: Tables) -> DataFrame:
    return textindex.phrase(t.documents.sparkSession, textindex.index_of(t.documents, "doc_id", "text"), ["mit", "license"])


def _first_vector(t: Tables) -> list[float]:
    """The query vector: that of the smallest vec_id (one row)."""
    return t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]


_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2)))"
_Q = "(SELECT vec_id AS q_id, embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_L2}, vec_id LIMIT 10")
def knn_l2_topk(t: Tables) -> DataFrame:
    return search.knn(t.embeddings, _first_vector(t), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q} ORDER BY {_L2}, vec_id LIMIT 10")
def knn_cells_topk(t: Tables) -> DataFrame:
    near, _ = vectorcells.knn(t.embeddings.sparkSession, vectorcells.cells_of(t.embeddings), _first_vector(t), 10)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings e, {_Q} WHERE label IN (1, 2) ORDER BY {_L2}, vec_id LIMIT 10")
def knn_cells_prefilter(t: Tables) -> DataFrame:
    near, _ = vectorcells.knn(t.embeddings.sparkSession, vectorcells.cells_of(t.embeddings), _first_vector(t), 10, F.col("label").isin(1, 2))
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({_L2}, 6) AS distance FROM embeddings e, {_Q} WHERE label IN (1, 2) ORDER BY {_L2}, vec_id LIMIT 10")
def knn_prefilter(t: Tables) -> DataFrame:
    near = search.knn(t.embeddings, _first_vector(t), 10, F.col("label").isin(1, 2))
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings e, {_Q} WHERE vec_id <> q_id ORDER BY {_L2}, vec_id LIMIT 10")
def knn_self_exclude(t: Tables) -> DataFrame:
    own = t.embeddings.agg(F.min("vec_id")).first()[0]
    near = search.knn(t.embeddings, _first_vector(t), 11).where(F.col("vec_id") != own).orderBy("distance", "vec_id").limit(10)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH k AS (SELECT vec_id, {_L2} AS d, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings e, {_Q} QUALIFY rank <= 30)
  SELECT vec_id, CAST(rank AS BIGINT) AS rank, source FROM k JOIN documents ON doc_id = vec_id""")
def knn_hydrate(t: Tables) -> DataFrame:
    near = search.knn(t.embeddings, _first_vector(t), 30)
    ranked = search.channel_ranks(near.withColumn("channel", F.lit("vector")), "channel", "distance", "vec_id")
    facts = t.documents.select(F.col("doc_id").alias("vec_id"), "source")
    return ranked.select("vec_id", F.col("rank").cast("long").alias("rank")).join(facts, "vec_id")


@query(f"SELECT vec_id, round(greatest(-1, least(1, 1 - {_L2} ** 2 / 2)), 4) AS cosine FROM embeddings e, {_Q}")
def cosine_from_l2(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first_vector(t)])
    return t.embeddings.select("vec_id", F.round(search.cosine_from_l2(search.l2(F.col("embedding"), q)), 4).alias("cosine"))


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dim FROM embeddings WHERE label > 2 GROUP BY 1")
def vec_count_filtered(t: Tables) -> DataFrame:
    return t.embeddings.where("label > 2").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


@query(f"""WITH {_BM25}, f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100),
  v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings e, {_Q} QUALIFY rank <= 100),
  s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
  u AS (SELECT 'fts' AS channel, * FROM f UNION ALL SELECT 'vector', * FROM v UNION ALL SELECT 'sql', * FROM s)
  SELECT id, string_agg(channel, ',' ORDER BY channel) AS channels, min(rank) AS best_rank FROM u GROUP BY 1""")
def union_channels(t: Tables) -> DataFrame:
    return _channels(t).select("id", F.array_join("channels", ",").alias("channels"), F.col("best_rank").cast("long").alias("best_rank"))


def _channels(t: Tables) -> DataFrame:
    """Hits of the three channels, up to 100 each: BM25, vectors and a relational order."""
    index = textindex.index_of(t.documents, "doc_id", "text")
    scored = textindex.bm25(t.documents.sparkSession, index, QUERY).withColumn("score", F.round("score", 6))
    fts = scored.orderBy(F.desc("score"), "doc_id").limit(100).select(F.col("doc_id").alias("id"), "score", F.lit("fts").alias("c"))
    vec = search.knn(t.embeddings, _first_vector(t), 100).select(F.col("vec_id").alias("id"), "distance", F.lit("vector").alias("c"))
    sql = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100).select(F.col("doc_id").alias("id"), "n_chars", F.lit("sql").alias("c"))
    return search.union_channels(
        ("fts", search.channel_ranks(fts, "c", F.desc("score"), "id")),
        ("vector", search.channel_ranks(vec, "c", "distance", "id")),
        ("sql", search.channel_ranks(sql, "c", F.desc("n_chars"), "id")),
    )


#: Documents as facts: their kind, subject, file and commit follow from their number, their confidence from their label.
_KINDS = ("configuration", "rendering", "dependency", "cache", "module_contract", "technical_debt")
QUESTION = "Why is /p/7 missing a license for things released? KEY_3 and cache rules"
_FACTS = f"""facts AS (SELECT d.doc_id AS id, coalesce(source, 'none') AS repository, {list(_KINDS)!r}[d.doc_id % 6 + 1] AS kind,
    CASE d.doc_id % 6 WHEN 0 THEN 'config:KEY_' || d.doc_id % 40 WHEN 1 THEN 'route:/p/' || d.doc_id % 50 ELSE 'src/m' || d.doc_id % 30 || '.ts' END AS subject,
    'src/m' || d.doc_id % 30 || '.ts' AS source_file, text AS content, n_chars > 2000 AS located, l.doc_id IS NOT NULL AS labelled,
    CASE WHEN l.quality = 1 THEN 0.55 WHEN l.quality = 0 THEN 0.25 ELSE 0.35 END AS confidence, CASE WHEN d.doc_id % 3 = 1 THEN 1.0 ELSE 0.2 END AS fresh
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  words AS (SELECT unnest(['missing', 'license', 'things', 'released', 'key', 'cache', 'rules']) AS w),
  rel AS (SELECT id, list_distinct(regexp_extract_all(lower(regexp_replace(subject || ' ' || source_file, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')) AS own,
    list_distinct(regexp_extract_all(lower(strip_accents(regexp_replace(coalesce(substr(content, 1, 600), ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), '[\\p{{L}}\\p{{N}}]+')) AS told FROM facts),
  near AS (SELECT id, avg(CASE WHEN len(list_filter(own, lambda x: x = w OR (length(x) >= 4 AND length(w) >= 4 AND (starts_with(x, w) OR starts_with(w, x))))) > 0 THEN 0.75 ELSE 0 END
      + CASE WHEN len(list_filter(told, lambda x: x = w OR (length(x) >= 4 AND length(w) >= 4 AND (starts_with(x, w) OR starts_with(w, x))))) > 0 THEN 0.25 ELSE 0 END) AS relevance FROM rel, words GROUP BY 1),
  base AS (SELECT id, repository || ':' || CASE kind WHEN 'configuration' THEN subject WHEN 'rendering' THEN subject ELSE kind || ':' || subject END AS entity,
    0.2 * CASE WHEN subject = 'route:/p/7' OR subject = 'config:KEY_3' THEN 1 WHEN kind = 'cache' THEN 1 WHEN kind IN ('configuration', 'module_contract', 'rendering') THEN 0.8 ELSE 0.55 END
    + 0.25 * relevance + 0.18 * 0.2 + 0.12 * fresh + 0.15 * least(1, confidence + 0.2 + CASE WHEN located THEN 0.2 ELSE 0 END)
    + 0.05 * CASE WHEN kind IN ('configuration', 'rendering') THEN 1 ELSE 0.8 END AS score FROM facts JOIN near USING (id))"""


def _facts(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", "quality", F.lit(1).alias("n_evidence"))
    n, number = F.col("doc_id") % 6, lambda k: (F.col("doc_id") % k).cast("string")
    file = F.concat(F.lit("src/m"), number(30), F.lit(".ts"))
    subject = F.when(n == 0, F.concat(F.lit("config:KEY_"), number(40))).when(n == 1, F.concat(F.lit("route:/p/"), number(50))).otherwise(file)
    return t.documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("none")).alias("repository"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (n + 1).cast("int")).alias("kind"),
        subject.alias("subject"),
        F.col("text").alias("content"),
        file.alias("source_file"),
        F.concat(F.lit("s"), number(3)).alias("commit_sha"),
        F.lit("s1").alias("repository_sha"),
        F.when(F.col("quality") == 1, "observed").when(F.col("quality") == 0, "inferred").alias("confidence"),
        F.lit(None).cast("double").alias("quality"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        (F.col("n_chars") > 2000).cast("int").alias("n_located"),
    )


def _all_hits(t: Tables) -> DataFrame:
    """Every fact as the first hit of one channel: ranking without a search."""
    return t.documents.select(F.col("doc_id").alias("id"), F.array(F.lit("sql")).alias("channels"), F.lit(1).alias("best_rank"))


@query(f"WITH {_FACTS} SELECT entity, max(round(CAST(score + 0.05 AS DOUBLE), 6)) AS score, count(*) - 1 AS n_duplicates FROM base GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def rank_dedupe(t: Tables) -> DataFrame:
    return search.hybrid(_facts(t), _all_hits(t), QUESTION, 50).select("entity", "score", "n_duplicates")


def _scores(t: Tables) -> DataFrame:
    """doc_id, source, score of each document by how fresh and how well founded it is."""
    facts = _facts(t)
    quality = search.evidence_quality(F.coalesce("confidence", F.lit("")), F.col("quality"), F.lit(True), F.col("n_located") > 0, F.lit(False))
    total = search.WEIGHTS["freshness"] * search.freshness(F.col("commit_sha"), F.col("repository_sha")) + search.WEIGHTS["evidence_quality"] * quality
    return facts.select(F.col("id").alias("doc_id"), F.col("repository").alias("source"), F.round(total, 6).alias("score"))


_SCORES = f"WITH {_FACTS}, s AS (SELECT id AS doc_id, repository AS source, round(CAST(0.12 * fresh + 0.15 * least(1, confidence + 0.2 + CASE WHEN located THEN 0.2 ELSE 0 END) AS DOUBLE), 6) AS score FROM facts)"


@query(f"{_SCORES} SELECT doc_id, score FROM s")
def ranking_features(t: Tables) -> DataFrame:
    return _scores(t).select("doc_id", "score")


@query(f"{_SCORES} SELECT source, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
def rank_best_per_entity(t: Tables) -> DataFrame:
    return relational.best_per(_scores(t), ["source"], "score", "doc_id").select("source", "doc_id", "score")


@query(f"""WITH {_BM25}, {_FACTS}, f AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100),
  v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings e, {_Q} QUALIFY rank <= 100),
  s AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
  u AS (SELECT 'fts' AS channel, * FROM f UNION ALL SELECT 'vector', * FROM v UNION ALL SELECT 'sql', * FROM s),
  h AS (SELECT entity, channel, rank, id, score FROM base JOIN u ON u.doc_id = id),
  e AS (SELECT entity, min(rank) AS best, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT id) - 1 AS n_duplicates FROM h GROUP BY 1),
  k AS (SELECT entity, id, max(round(CAST(score + 0.05 / best AS DOUBLE), 6)) AS score FROM h JOIN e USING (entity) GROUP BY ALL)
  SELECT entity, id, score, n_duplicates, channels FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, id) AS n FROM k) JOIN e USING (entity) WHERE n = 1 ORDER BY score DESC, entity LIMIT 10""")
def hybrid_search(t: Tables) -> DataFrame:
    return search.hybrid(_facts(t), _channels(t), QUESTION, 10)


@query("""SELECT p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(p_name || p_brand || 'FooBar', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]{3,}'), ' ') AS terms
  FROM part""")
def tokenize_camel(t: Tables) -> DataFrame:
    joined = F.concat(F.col("p_name"), F.col("p_brand"), F.lit("FooBar"))
    found = F.regexp_extract_all(text.fold(text.camel_split(joined)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return t.part.select("p_partkey", F.array_join(found, " ").alias("terms"))


@query("""WITH w AS (SELECT unnest(['license', 'released', 'thing', 'ering']) AS w), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(strip_accents(substr(text, 1, 600))), '[\\p{L}\\p{N}]+')) AS g FROM documents)
  SELECT doc_id, round(sum(CASE WHEN len(list_filter(g, lambda x: x = w OR (length(x) >= 4 AND (starts_with(x, w) OR starts_with(w, x))))) > 0 THEN 1 ELSE 0 END) / 4.0, 4) AS relevance
  FROM d, w GROUP BY 1""")
def relevance_score(t: Tables) -> DataFrame:
    given = F.array_distinct(text.tokens(F.substring("text", 1, 600)))
    wanted = F.array(*map(F.lit, ("license", "released", "thing", "ering")))
    docs = t.documents.select("doc_id", given.alias("g"))
    return docs.select("doc_id", F.round(text.hit_ratio(wanted, F.col("g")), 4).alias("relevance"))


_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END"


@query(f"""WITH k AS (SELECT page_id, CASE WHEN regexp_replace(lower({_PATH}), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower({_PATH}), '/+$', '') END AS route FROM pages)
  SELECT route, count(*) AS n, min(page_id) AS first_page FROM k GROUP BY 1""")
def route_identity_match(t: Tables) -> DataFrame:
    keyed = t.pages.select("page_id", text.route_key(text.url_path(F.col("url"))).alias("route"))
    return keyed.groupBy("route").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"SELECT page_id, {_PATH} AS path, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) AS depth FROM pages")
def path_to_route(t: Tables) -> DataFrame:
    path = text.url_path(F.col("url"))
    return t.pages.select("page_id", path.alias("path"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long").alias("depth"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://', ''), '[?#].*$', ''), '(\\.git)?/*$', '') AS remote FROM pages""")
def normalize_remote(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normal_remote(F.col("url")).alias("remote"))


@query("SELECT conv_id, turn, substr(sha256(lower(trim(text))), 1, 32) AS hash FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def query_hash(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user' and text is not null").select("conv_id", "turn", text.question_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CAST(ceil(n_chars / 3.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_estimate(F.col("n_chars")).alias("tokens"))


@query("""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '\\b[A-Z][A-Z0-9_]{2,}\\b'), lambda x: x NOT IN ('API', 'CDN', 'CI', 'CSR', 'DFS', 'HTML', 'HTTP', 'ISR', 'JS', 'JSON', 'RCE', 'RSC', 'SHA', 'SQL', 'SSR', 'TS', 'TSX', 'UI', 'URL')))) AS n
  FROM documents""")
def anchors_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.config_anchors(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query("""SELECT p_partkey, p_brand || ':' || CASE WHEN p_type LIKE '%A%' THEN 'config:' || p_name WHEN p_size > 25 THEN 'route:/' || p_brand ELSE 'fact:' || p_name END AS entity FROM part""")
def canonical_entity_key(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type").like("%A%"), "configuration").otherwise("fact")
    subject = F.when(kind == "configuration", F.concat(F.lit("config:"), F.col("p_name"))).when(F.col("p_size") > 25, F.concat(F.lit("route:/"), F.col("p_brand"), F.lit(":12"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", search.entity_key(F.col("p_brand"), kind, subject).alias("entity"))


@query("""WITH a(canonical, alias) AS (VALUES ('license', 'license'), ('license', 'mit'), ('license', 'released under'), ('insult', 'worthless'), ('insult', 'trash'))
  SELECT doc_id, canonical, count(*) AS n_aliases, max(length(alias)) AS strength FROM documents JOIN a ON contains(' ' || lower(text) || ' ', ' ' || alias || ' ') GROUP BY ALL""")
def alias_expand(t: Tables) -> DataFrame:
    aliases = [("license", "license"), ("license", "mit"), ("license", "released under"), ("insult", "worthless"), ("insult", "trash")]
    spoken = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    entries = F.array(*[F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("alias")) for c, a in aliases])
    said = F.filter(entries, lambda e: F.contains(spoken, F.concat(F.lit(" "), e["alias"], F.lit(" "))))
    rows = t.documents.select("doc_id", F.explode(said).alias("e")).select("doc_id", "e.*")
    return rows.groupBy("doc_id", "canonical").agg(F.count("*").alias("n_aliases"), F.max(F.length("alias")).alias("strength"))


#: The first question of a conversation names a group of its scope (20 conversations): its first two words, aliases behind them.
_FOLDED = "trim(regexp_replace(lower(strip_accents(replace({}, 'ı', 'i'))), '[^a-z0-9_@./\\[\\]-]+', ' ', 'g'))"


@query(f"""WITH u AS (SELECT conv_id, turn, conv_id // 20 AS scope, {_FOLDED.format("text")} AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL),
  w AS (SELECT scope, string_split(q, ' ') AS w FROM u WHERE turn = 0 AND len(string_split(q, ' ')) >= 6),
  g AS (SELECT DISTINCT scope, w[1] || ' ' || w[2] AS canonical, unnest([w[1] || ' ' || w[2], w[3] || ' ' || w[4], w[5], w[4] || ' ' || w[5] || ' ' || w[6]]) AS term FROM w),
  r AS (SELECT DISTINCT scope, '/' || w[1] || '/' || w[2] AS route FROM w WHERE NOT contains(w[1] || w[2], '[')
    UNION SELECT scope, '/shop/' || w[5] FROM w WHERE NOT contains(w[5], '[')),
  keys AS (SELECT scope, route, regexp_replace(route, '^/', '') AS key, 0 AS rank FROM r
    UNION ALL SELECT scope, route, trim(regexp_replace(regexp_replace(route, '^/', ''), '[-_/]+', ' ', 'g')), 1 FROM r
    UNION ALL SELECT scope, route, unnest(list_filter(string_split(route, '/'), lambda s: s <> '')), 2 FROM r),
  m AS (SELECT DISTINCT conv_id, turn, u.scope, q, canonical, term FROM u JOIN g ON g.scope = u.scope AND contains(' ' || q || ' ', ' ' || term || ' ')),
  c AS (SELECT conv_id, turn, scope, q, canonical, list(term) AS ts, max(length(term)) AS strength, bool_or(term = canonical) AS own, bool_or(term = q) AS whole FROM m GROUP BY ALL),
  s AS (SELECT *, CASE WHEN own THEN 10000 ELSE 0 END + CASE WHEN whole THEN 5000 ELSE 0 END
    + list_sum(list_transform(list_filter(ts, lambda t: len(list_filter(ts, lambda v: v <> t AND contains(v, t))) = 0), lambda t: length(t))) AS score FROM c),
  n AS (SELECT scope, key, arg_min(route, (greatest(rank, 1), route)) AS route FROM keys GROUP BY 1, 2),
  d AS (SELECT conv_id, turn, route, strength, own, score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, route, strength DESC) AS k FROM s JOIN n ON n.scope = s.scope AND n.key = s.canonical),
  l AS (SELECT conv_id, turn, arg_min(route, (rank, route)) AS route FROM (SELECT DISTINCT conv_id, turn, s.scope, g.term FROM s JOIN g ON g.scope = s.scope AND g.canonical = s.canonical
      WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = s.conv_id AND d.turn = s.turn)) x JOIN keys ON keys.scope = x.scope AND keys.key = x.term AND rank <> 1 GROUP BY 1, 2)
  SELECT conv_id, turn, route, CAST(strength AS INTEGER) AS strength, own AS canonical_mentioned, CAST(score AS BIGINT) AS score FROM d WHERE k = 1
  UNION ALL SELECT conv_id, turn, route, (SELECT CAST(max(strength) AS INTEGER) FROM s WHERE s.conv_id = l.conv_id AND s.turn = l.turn), false, NULL FROM l""")
def alias_routes(t: Tables) -> DataFrame:
    asked = t.conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), F.expr("conv_id div 20").alias("scope"), "text", "turn")
    w = F.split(aliases.folded(F.col("text")), " ")
    first = asked.where("turn = 0").select("scope", w.alias("w")).where(F.size("w") >= 6)
    said = lambda *at: F.concat_ws(" ", *[F.get("w", i) for i in at])
    words = first.select("scope", said(0, 1).alias("canonical"), F.explode(F.array(said(2, 3), said(4), said(3, 4, 5))).alias("alias"))
    paths = F.array(F.concat(F.lit("/"), F.get("w", F.lit(0)), F.lit("/"), F.get("w", F.lit(1))), F.concat(F.lit("/shop/"), F.get("w", F.lit(4))))
    found = aliases.route_matches(asked.select("qid", "scope", "text"), words, first.select("scope", F.explode(paths).alias("route")))
    return found.select("qid.conv_id", "qid.turn", "route", "strength", "canonical_mentioned", "score")


def _values(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


@query(f"""WITH r(intent, weight, pattern) AS (VALUES {_values((i, w, p) for i, rules_ in rules.INTENT_RULES.items() for w, p in rules_)}),
  c AS (SELECT conv_id, turn, lower(strip_accents(replace(text, 'ı', 'i'))) AS said FROM conversations WHERE role = 'user'),
  n AS (SELECT DISTINCT intent FROM r),
  s AS (SELECT conv_id, turn, n.intent, coalesce(sum(weight) FILTER (regexp_matches(said, pattern)), 0) AS score FROM c, n JOIN r ON r.intent = n.intent GROUP BY ALL),
  k AS (SELECT *, row_number() OVER o AS n, score - lead(score) OVER o AS margin FROM s WINDOW o AS (PARTITION BY conv_id, turn ORDER BY score DESC, intent DESC))
  SELECT conv_id, turn, CASE WHEN score >= 4 AND margin > 0 THEN intent ELSE 'unknown' END AS intent,
    CASE WHEN score < 4 OR margin = 0 THEN 'low' WHEN score >= 7 AND margin >= 3 THEN 'high' WHEN margin >= 2 THEN 'medium' ELSE 'low' END AS confidence,
    CAST(score AS INTEGER) AS score, CAST(margin AS INTEGER) AS margin FROM k WHERE n = 1""")
def intent_score_rules(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", rules.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.*")


@query(f"""WITH r(place, kind, pattern) AS (VALUES {_values((i, k, p) for i, (k, p) in enumerate(rules.TYPE_TERMS.items()))}),
  f AS (SELECT doc_id, text, list(kind ORDER BY place) FILTER (regexp_matches(text, '(?i)' || pattern)) AS kinds FROM documents, r GROUP BY ALL)
  SELECT doc_id, coalesce(array_to_string(CASE WHEN list_contains(kinds, 'analytics_event') AND NOT regexp_matches(text, '(?i)\\b(schema|validation|zod|yup|valibot|formdata|form payload|json payload)\\b')
    THEN list_filter(kinds, lambda x: x <> 'schema_contract') ELSE kinds END, ','), '') AS kinds FROM f""")
def memory_type_inference(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(rules.memory_types(F.coalesce("text", F.lit(""))), ",").alias("kinds"))


#: Parts of paths, dealt to pages by their number.
_FOLDERS = ("", "src/", "app/", "src/app/shop/", "pages/", "services/", "src/providers/", "lib/api/", "docs/")
_FILES = ("package.json", "yarn.lock", "next.config.mjs", "middleware.ts", "Dockerfile", ".env.local", "robots.txt", "page.tsx", "client.js", "README.md", "queries\\list.ts")
_FILE = f"replace({list(_FOLDERS)!r}[page_id % {len(_FOLDERS)} + 1] || {list(_FILES)!r}[page_id // {len(_FOLDERS)} % {len(_FILES)} + 1], '\\\\', '/')"


@query(f"""WITH p AS (SELECT page_id, {_FILE} AS file FROM pages),
  k AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(file, '{p}') THEN {i}" for i, (p, _) in enumerate(rules.PATH_KINDS))} ELSE -1 END AS rule FROM p)
  SELECT page_id, file, CASE rule {' '.join(f"WHEN {i} THEN '{','.join(k.split())}'" for i, (_, k) in enumerate(rules.PATH_KINDS))} ELSE '' END
    || CASE WHEN rule = {len(rules.PATH_KINDS) - 1} AND regexp_matches(file, '(^|/)(?:app|pages)/') THEN ',route' ELSE '' END AS kinds FROM k""")
def change_classifier(t: Tables) -> DataFrame:
    # Kinds that the second list adds beside `route` are among a source's kinds already.
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    folder = at(_FOLDERS, F.col("page_id") % len(_FOLDERS))
    path = F.concat(folder, at(_FILES, F.floor(F.col("page_id") / len(_FOLDERS)) % len(_FILES)))
    file = F.replace(path, F.lit("\\"), F.lit("/"))
    return t.pages.select("page_id", file.alias("file"), F.array_join(rules.path_kinds(path), ",").alias("kinds"))


@query(r"""WITH n AS (SELECT p_partkey, ['react', '@team/ui', 'axios', 'zustand', 'sass', 'next-auth', 'vitest', 'segment', 'left-pad', 'react-query'][p_size % 10 + 1] AS name, ['^', '', 'next@', '~', 'v'][p_partkey % 5 + 1] || p_size || '.1.0' AS version FROM part)
  SELECT p_partkey, CASE WHEN starts_with(name, '@team/') THEN 'internal-package' WHEN name = 'react' THEN 'framework/runtime' WHEN name IN ('axios', 'react-query') THEN 'data-fetching'
    WHEN name = 'zustand' THEN 'state-management' WHEN name = 'sass' THEN 'styling' WHEN name = 'next-auth' THEN 'authentication' WHEN name = 'vitest' THEN 'testing' WHEN name = 'segment' THEN 'analytics' END AS category,
    TRY_CAST(coalesce(nullif(regexp_extract(version, '(?i)(?:^|\bnext[-@/])v?(\d{1,2})\.', 1), ''), nullif(regexp_extract(version, '^[~^<>=\s]*v?(\d{1,2})\.', 1), '')) AS INTEGER) AS major FROM n""")
def package_profile(t: Tables) -> DataFrame:
    names = ("react", "@team/ui", "axios", "zustand", "sass", "next-auth", "vitest", "segment", "left-pad", "react-query")
    at = lambda of, i: F.element_at(F.array(*map(F.lit, of)), (i + 1).cast("int"))
    version = F.concat(at(("^", "", "next@", "~", "v"), F.col("p_partkey") % 5), F.col("p_size").cast("string"), F.lit(".1.0"))
    return t.part.select("p_partkey", rules.package_category(at(names, F.col("p_size") % 10), "@team/").alias("category"), rules.next_major(version).alias("major"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words,
  CASE WHEN length(text) < 40 THEN 'xs' WHEN length(text) < 120 THEN 's' WHEN length(text) < 400 THEN 'm' ELSE 'l' END AS bucket, regexp_matches(text, '[çğıöşüÇĞİÖŞÜ]') AS turkish,
  regexp_matches(text, '(^|\s)/[\w\[\]/-]*') AS route, regexp_matches(text, '[\w/-]+\.(?:tsx?|jsx?|json|mjs|cjs)\b') AS file, regexp_matches(text, '\b[A-Z][A-Z0-9_]{3,}\b') AS config
  FROM conversations WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def query_shape_buckets(t: Tables) -> DataFrame:
    return t.conversations.where("text is not null").select("conv_id", "turn", rules.question_shape(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query("""SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')), ['the', 'license', 'thing', 'released'])) AS overlap
  FROM documents ORDER BY overlap DESC, doc_id DESC LIMIT 20""")
def decision_term_overlap(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("the", "license", "thing", "released")))
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    overlap = F.size(F.array_intersect(found, wanted)).cast("long")
    return t.documents.select("doc_id", overlap.alias("overlap")).orderBy(F.desc("overlap"), F.desc("doc_id")).limit(20)


@query("""SELECT a.p_partkey AS p_partkey, len(list_intersect(list_distinct(regexp_extract_all(lower(a.p_name), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(a.p_type), '[a-z0-9]+')))) AS n_shared FROM part a""")
def intersect_terms(t: Tables) -> DataFrame:
    both = F.array_intersect(text.tokens(F.col("p_name")), text.tokens(F.col("p_type")))
    return t.part.select("p_partkey", F.size(both).cast("long").alias("n_shared"))


@query("""WITH r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
  SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 8000 OR k = 1""")
def budget_prefix(t: Tables) -> DataFrame:
    return budget.prefix_within(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 8000).select("source", "doc_id", "used")


@query()
def budget_skip_fold(t: Tables) -> DataFrame:
    return budget.skip_within(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 8000)


@query()
def pca_explained(t: Tables) -> DataFrame:
    rows, explained = projection.project(t.embeddings)
    return rows.select("vec_id", "axes", F.array(*[F.lit(x) for x in explained]).alias("explained"))


@query()
def vector_picture(t: Tables) -> DataFrame:
    return projection.picture(t.embeddings)[0]


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS mean FROM v GROUP BY 1)
  SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(CAST(a.x AS DOUBLE) * b.x) - any_value(ma.mean * mb.mean), 6) + 0.0 AS covariance
  FROM v a JOIN v b USING (vec_id) JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i""")
def vector_covariance(t: Tables) -> DataFrame:
    _, _, covariance = projection.moments(t.embeddings)
    rows = [(i, j, round(float(x), 6) + 0.0) for i, row in enumerate(covariance) for j, x in enumerate(row)]
    return t.embeddings.sparkSession.createDataFrame(rows, "i int, j int, covariance double")
