"""SQL of the corpus queries that takes more than a statement to write down."""

from __future__ import annotations

from vacantia.llm import licenses


def licenses_sql() -> str:
    """Words, votes, diagonals, copies and labels as joins and windows over all words."""
    templates = [*licenses.PHRASES, *licenses.NOTICES]
    rows = ", ".join(
        f"({n}, '{t.label}', '{t.text.lower()}', {str(t.phrase).lower()}, {n < len(licenses.PHRASES)})"
        for n, t in enumerate(templates))
    cut = r"list_filter(regexp_split_to_array({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    cut = cut.replace("\\\\", "\\")
    k, slack, least = licenses.K, licenses.SLACK, licenses.LEAST_SHARE
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (
  SELECT n, label, phrase, base, {cut.format('body')} AS w FROM (VALUES {rows}) v(n, label, body, phrase, base)
), tg AS (
  SELECT n, unnest(range(0, len(w) - {k - 1})) AS at_, unnest(list_transform(range(1, len(w) - {k - 2}),
    lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM t
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {cut.format(low)} AS w FROM documents
), dg AS (
  SELECT rid, unnest(range(0, len(w) - {k - 1})) AS pos, unnest(list_transform(range(1, len(w) - {k - 2}),
    lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM d
), hit AS (SELECT rid, n, pos, at_, pos - at_ AS diagonal FROM dg JOIN tg USING (gram)
), near AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, n ORDER BY diagonal)
    > CASE WHEN phrase THEN 0 ELSE {slack} END THEN 1 ELSE 0 END AS far
  FROM (SELECT DISTINCT rid, n, diagonal FROM hit) JOIN t USING (n)
), copy_ AS (SELECT rid, n, diagonal, sum(far) OVER (PARTITION BY rid, n ORDER BY diagonal) AS c FROM near
), at_words AS (
  SELECT DISTINCT rid, n, c, at_ + j AS word FROM hit JOIN copy_ USING (rid, n, diagonal), range({k}) g(j)
), ends AS (
  SELECT rid, n, c, min(pos) AS first, max(pos) + {k - 1} AS last FROM hit JOIN copy_ USING (rid, n, diagonal) GROUP BY ALL
), judged AS (
  SELECT rid, n, first, last, label, base, count(*) / len(w) AS share, count(*) / (last - first + 1) AS dense,
    CASE WHEN phrase THEN 1.0::DOUBLE ELSE {least}::DOUBLE END AS least
  FROM at_words JOIN ends USING (rid, n, c) JOIN t USING (n) GROUP BY rid, n, c, first, last, label, base, w, phrase
), found AS (SELECT * FROM judged WHERE share >= least AND dense >= least
), best AS (SELECT rid, max(share) AS score FROM judged GROUP BY rid
), per_doc AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM found GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per_doc USING (rid) LEFT JOIN best USING (rid)"""


def clustering_sql(clusters: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """Every round written out: distances to all centroids, then floors of the means."""
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: isfinite(x))) = {components}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS cluster, v AS c FROM kept
  QUALIFY cluster < {clusters}
)"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, vec_id, v, cluster, distance FROM (
    SELECT rid, vec_id, v, cluster, list_sum(list_transform(range(1, {components + 1}),
      lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM kept, c{n})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN (
    SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS k FROM a{n}, range(1, {components + 1}) g(i) GROUP BY cluster, i)
    GROUP BY cluster) m ON m.cluster = o.cluster
)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
