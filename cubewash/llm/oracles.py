"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from cubewash.llm import centroid_clusters as cc

_FILTER_AUDIT = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM words),
weights AS (
  SELECT part, fails, count(*) AS n,
         count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
gone AS (
  SELECT part, filter_order, fails, n, good, toxic,
         coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) AS place
  FROM weights, orders),
steps AS (
  SELECT part, filter_order, s AS step, substr(filter_order, s, 1) AS f,
         sum(n) FILTER (WHERE place > s) AS kept, sum(n) FILTER (WHERE place = s) AS removed,
         sum(n) FILTER (WHERE place < s AND contains(fails, substr(filter_order, s, 1))) AS redundant,
         sum(n) FILTER (WHERE fails = substr(filter_order, s, 1)) AS unique_fails,
         sum(good) FILTER (WHERE place = s) AS good_lost, sum(toxic) FILTER (WHERE place = s) AS toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY part, filter_order, s)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM steps
"""


def _clusters_sql() -> str:
    """Rounds written out one after another; vectors stand as one row per component."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {cc.SCALE})::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {cc.DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
v AS MATERIALIZED (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM kept),
first AS (
  SELECT row_number() OVER (ORDER BY sha256('{cc.SEED}:' || vec_id)) - 1 AS k, vec_id FROM kept
  QUALIFY k < {cc.CLUSTERS}),
c0 AS MATERIALIZED (SELECT k, i, x FROM first JOIN v USING (vec_id))"""]
    for r in range(cc.ROUNDS + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (
    SELECT vec_id, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY vec_id, k)
  GROUP BY vec_id)""")
        if r < cc.ROUNDS:
            parts.append(f"""
s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (
  SELECT k, i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{r} c LEFT JOIN s{r} USING (k, i))""")
    return ",".join(parts) + f""",
shas AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{cc.ROUNDS} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{cc.ROUNDS} JOIN shas USING (k)
"""


_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

ORACLES = {
    "op11_filter_audit": _FILTER_AUDIT,
    "op12_centroid_clusters": _clusters_sql(),
    "op13_superminhash": _NEAR_DUPLICATES,
}
