"""SQL (DuckDB) for the rows of queries that need more than a few lines of it."""

from __future__ import annotations

#: Patterns of parts in secret scans, as RE2 reads them.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ID = r"""(?i)(?:client|account|tenant|user|access|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
_MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}"
_ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\x09-\x0D\x20"'<>]+"""
_DOTTED = r"[0-9]+(?:\.[0-9]+){3,}"
_TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_BLANK = r"\n[\x20\t\r]*\n"
_FOUR_OCTETS = """len(string_split(m, '.')) = 4 AND len(list_filter(string_split(m, '.'),
    lambda o: length(o) > 3 OR (length(o) > 1 AND o[1] = '0') OR CAST(o[1:3] AS INTEGER) > 255)) = 0"""
_MIXED = "regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]')"


def _found(kind: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """(r, kind, m, s, e) of a pattern's matches: their places follow from the lengths of what is before and between."""
    p = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM (
      SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(rest[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS s
      FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS rest FROM d)) WHERE {keep}"""


#: Base findings and weak parts by their definitions, and the interval join as a look at every pair of a block's parts.
OP3 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS MATERIALIZED (
  {_found("assign", _ASSIGN, "length(g) >= 12", 2)}
  UNION ALL {_found("access", "AKIA[A-Z0-9]+", "length(m) >= 18")}
  UNION ALL {_found("hex", "[0-9a-f]{16,}")}
), named AS MATERIALIZED (
  {_found("id", _ID)} UNION ALL {_found("id", _MAIL)}
  UNION ALL {_found("endpoint", _ENDPOINT)} UNION ALL {_found("endpoint", _DOTTED, _FOUR_OCTETS)}
), tokens AS MATERIALIZED ({_found("token", _TOKEN, _MIXED)}
), blank AS MATERIALIZED ({_found("blank", _BLANK)}
), parts AS MATERIALIZED (
  SELECT DISTINCT r, kind, m, s, e, (SELECT count(*) FROM blank b WHERE b.r = p.r AND b.s < p.s) AS block, kind <> 'hex' OR regexp_matches(m, '[a-f]') AS completes
  FROM (SELECT * FROM base
    UNION ALL SELECT * FROM named w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)
    UNION ALL SELECT * FROM tokens w WHERE NOT EXISTS (SELECT 1 FROM (FROM base UNION ALL FROM named) b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)) p
), linked AS (
  SELECT r, kind, s, e, list_position(['assign', 'access', 'hex', 'id', 'token', 'endpoint'], kind) AS k
  FROM parts p WHERE kind IN ('assign', 'access', 'hex') OR EXISTS (
    SELECT 1 FROM parts o WHERE o.r = p.r AND o.block = p.block AND o.completes AND o.s - p.e <= 300 AND p.s - o.e <= 300
      AND CASE p.kind WHEN 'id' THEN o.kind IN ('assign', 'hex', 'token') WHEN 'endpoint' THEN o.kind IN ('assign', 'access', 'hex', 'token')
        ELSE o.kind IN ('access', 'id', 'endpoint') END)
), n AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k <= 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM linked GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)
"""

#: Shards by the middle of each document in the running sum of bytes, in order of doc_id and then of the text's crc and size. The
#: crc is reduced over pieces of 1000 bytes (the first of a text is shorter); m says what 1000 further bytes make of each bit.
OP7 = """
WITH RECURSIVE crc_table AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), steps AS MATERIALIZED (SELECT list(c ORDER BY byte) AS x FROM crc_table WHERE k = 8
), moved AS MATERIALIZED (SELECT list(c ORDER BY j) AS m FROM (
    SELECT j, list_reduce([CAST(1 AS BIGINT) << j] || list_transform(range(1000), lambda i: CAST(0 AS BIGINT)), lambda c, b: xor(c >> 8, x[1 + xor(c & 255, b)])) AS c FROM range(32) t(j), steps)
), d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, 1 + strlen(coalesce(text, '')) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), cut AS (SELECT r, k, CASE WHEN k = 0 THEN h[1:2 * ((size - 1) % 1000)] ELSE h[2 * ((size - 1) % 1000) + 2000 * (k - 1) + 1:2 * ((size - 1) % 1000) + 2000 * k] END AS h
    FROM (SELECT r, size, h, unnest(range((size - 1) // 1000 + 1)) AS k FROM d)
), piece AS (SELECT r, k, list_reduce([CAST(CASE WHEN k = 0 THEN 4294967295 ELSE 0 END AS BIGINT)] ||
      list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(concat('0x', h[2 * i + 1:2 * i + 2]) AS BIGINT)), lambda c, b: xor(c >> 8, x[1 + xor(c & 255, b)])) AS c FROM cut, steps
), whole AS (SELECT r, list_reduce(list(c ORDER BY k), lambda c, p: list_reduce([p] || list_transform(m, lambda b, j: CASE WHEN (c >> (j - 1)) & 1 = 1 THEN b ELSE 0 END), lambda u, v: xor(u, v))) AS c
    FROM piece, moved GROUP BY r, m
), o AS (
  SELECT doc_id, size, xor(c, 4294967295) AS crc, sum(size) OVER by_id AS upto, sum(size) OVER () AS total, row_number() OVER by_id AS place
  FROM d JOIN whole USING (r) WINDOW by_id AS (ORDER BY doc_id NULLS FIRST, xor(c, 4294967295), size ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, CAST(least(7, floor((upto - size / 2) * 8 / total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def _said(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_said, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _nodes(name: str, rows: str) -> str:
    """Recursive nodes (g, level, pos, n, h) over rows (g, pos, n, h), and what stands beside each node as `before|after`."""
    return f"""{name} AS (SELECT g, 0 AS level, pos, n, h FROM ({rows})
  UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, n, pos // 2
), {name}_beside AS MATERIALIZED (SELECT a.g, a.level, a.pos, CASE WHEN a.pos % 2 = 1 THEN b.h || '|' ELSE '|' || coalesce(b.h, '') END AS s
  FROM {name} a LEFT JOIN {name} b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1
)"""


OP11 = f"""
WITH RECURSIVE crc_table AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc_steps AS MATERIALIZED (SELECT list(c ORDER BY byte) AS x FROM crc_table WHERE k = 8
), d AS MATERIALIZED (SELECT doc_id, lang AS g, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed,
    coalesce(xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda k: CAST(ascii(k) AS BIGINT)),
      lambda c, b: xor(c >> 8, x[1 + xor(c & 255, b)]))) % 7 = 0, false) AS picked FROM documents, crc_steps
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d
), {_nodes("low", "SELECT g, pos, n, leaf AS h FROM placed")
}, subroots AS MATERIALIZED (SELECT g AS name, h AS subroot, '' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), {_nodes("high", "SELECT g, pos, n, subroot AS h FROM subroots")
}, ways AS (
  SELECT doc_id, leaf, CASE WHEN picked THEN changed ELSE leaf END AS seen, subroot, (SELECT h FROM high WHERE n = 1) AS root,
    coalesce((SELECT list(s ORDER BY b.level) FROM low_beside b WHERE b.g IS NOT DISTINCT FROM p.g AND b.pos = p.pos >> b.level), [])
      || coalesce((SELECT list(s ORDER BY b.level) FROM high_beside b WHERE b.pos = r.pos >> b.level), []) AS steps
  FROM placed p JOIN subroots r ON r.name IS NOT DISTINCT FROM p.g
), f AS (SELECT *, list_reduce([seen] || steps, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

OP13 = """
WITH RECURSIVE crc_table AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc_steps AS MATERIALIZED (SELECT list(c ORDER BY byte) AS x FROM crc_table WHERE k = 8
), t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda k: CAST(ascii(k) AS BIGINT)), lambda c, b: xor(c >> 8, x[1 + xor(c & 255, b)]))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_steps
), r AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h
), p AS (SELECT conv_id, strlen(text) AS size, row_number() OVER w AS depth, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
), m AS MATERIALIZED (SELECT conv_id, depth, path, size FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c
), e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY 1
), n AS MATERIALIZED (SELECT depth, path, min(size) AS size, min(conv_id) AS owner, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM m JOIN e USING (conv_id) GROUP BY 1, 2
), up AS (SELECT n.depth, n.path, a.path AS above FROM n JOIN m a ON a.conv_id = n.owner AND a.depth = n.depth - 1
), kids AS (SELECT above AS path, count(*) AS n_children FROM up GROUP BY 1
), sub AS (SELECT a.path, sum((n_convs - 1) * n.size) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM n JOIN m a ON a.conv_id = n.owner AND a.depth <= n.depth LEFT JOIN kids ON kids.path = n.path GROUP BY 1)
SELECT n.owner AS conv_id, n.depth, v.owner AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN kids ON kids.path = n.path JOIN sub ON sub.path = n.path LEFT JOIN up ON up.path = n.path AND n.depth > 0 LEFT JOIN n v ON v.path = up.above AND v.depth = n.depth - 1
"""
