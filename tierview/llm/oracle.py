"""DuckDB SQL with the same rows as the registered queries, where SQL can say it."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, '.' || host AS h, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN starts_with(path, '/') AND (contains(h, '.casino') OR contains(h, '.porn') OR contains(h, '.ads.')) THEN 'block'
    WHEN ends_with(path, '/login') OR regexp_matches(h || path, '\.(exe|zip|jpg|png)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")

# Text cut into pieces that each end with a match; what is left of a text after its last match is in no piece.
_PIECES = """
  SELECT doc_id, {ord} AS ord, '{kind}' AS kind, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s:.*?)(?:{pattern})') AS p FROM documents)"""
_KINDS = (("assign", _ASSIGN, 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))

ORACLES["op4_secret_scan"] = f"""
WITH pieces AS ({" UNION ALL ".join(_PIECES.format(ord=n, kind=k, pattern=p) for n, (k, p, _, _) in enumerate(_KINDS))}),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS till,
    CASE ord {" ".join(f"WHEN {n} THEN length(regexp_extract(piece, '(?:{p})$', 0))" for n, (_, p, _, _) in enumerate(_KINDS))} END AS own,
    CASE ord {" ".join(f"WHEN {n} THEN length(regexp_extract(piece, '(?:{p})$', {g})) >= {m}" for n, (_, p, g, m) in enumerate(_KINDS))} END AS good
  FROM pieces),
told AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || CAST(till - own AS BIGINT) || ':' || CAST(till AS BIGINT), ',' ORDER BY till - own, ord) AS spans
  FROM placed WHERE good GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)
"""

ORACLES["op5_minhash"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""


# The checksum's table of 256 entries is built by its rule, eight steps for each byte.
ORACLES["op8_balanced_shards"] = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n)) AS t),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM documents),
summed AS (
  SELECT doc_id, size,
    xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM bytes, steps),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM summed),
dealt AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""

# Vectors as integers, one row for each component; rounds of assignment and floors of means, one CTE after the other.
_COMPONENTS = """
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT vec_id, (k - 1) // {width} AS p, (k - 1) % {width} AS i, x
  FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM kept)),
book0 AS MATERIALIZED (
  SELECT p, e, i, x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY {order}) - 1 AS e FROM kept) USING (vec_id)
  WHERE e < 16)"""
_ASSIGNED = """
near{n} AS MATERIALIZED (
  SELECT vec_id, p, CAST(min(d * 16 + e) % 16 AS BIGINT) AS e, CAST(min(d * 16 + e) // 16 AS BIGINT) AS d
  FROM (SELECT vec_id, p, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN book{n} b USING (p, i) GROUP BY ALL)
  GROUP BY vec_id, p)"""
_MOVED = """
book{next} AS MATERIALIZED (
  SELECT p, e, i, coalesce(mean, x) AS x FROM book{n} LEFT JOIN (
    SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean
    FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM cells JOIN near{n} USING (vec_id, p) GROUP BY p, e, i)) USING (p, e, i))"""


def _rounds(rounds: int, scale: int, width: int, order: str) -> str:
    steps = [_COMPONENTS.format(scale=scale, width=width, order=order)]
    for n in range(rounds):
        steps += [_ASSIGNED.format(n=n), _MOVED.format(n=n, next=n + 1)]
    return ",".join([*steps, _ASSIGNED.format(n=rounds)])


ORACLES["op11_vector_codes"] = f"""
WITH {_rounds(6, 4096, 8, "vec_id")},
told AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near6 JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book6) AS codebooks_sha256
FROM told
"""

ORACLES["op13_orchard_clusters"] = f"""
WITH {_rounds(3, 64, 64, "sha256('1:' || CAST(vec_id AS VARCHAR))")},
digests AS (SELECT e, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM book3 GROUP BY e)
SELECT vec_id, CAST(e AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY e) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN digests USING (e)
"""
