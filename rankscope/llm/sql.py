"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from rankscope.llm import angular, secrets, threshold, wumanber


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_sql() -> str:
    """op4: matches by extraction, offsets by running lengths of the text between them, owners by value."""
    runs = {"hex": "([0-9a-f]{24,})", "owned": "([A-Za-z0-9+/_-]{24,})"}
    added = secrets.ADDED[0]
    kinds = [*secrets.KINDS, secrets.ADDED]
    found = " UNION ALL ".join(
        f"SELECT doc_id, owner, repo, '{kind}' AS kind, {number} AS kind_no, {least} AS least, "
        f"regexp_extract_all(t, {_quoted(runs.get(kind, pattern))}) AS w, "
        f"regexp_extract_all(t, {_quoted(runs.get(kind, pattern))}, {group}) AS v, "
        f"string_split_regex(t, {_quoted(runs.get(kind, pattern))}) AS b FROM d"
        for number, (kind, pattern, group, least) in enumerate(kinds))
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.KINDS)
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE('=' || source, '') AS owner,
                  {{'s': source, 'l': lang}} AS repo FROM documents),
x AS ({found}),
m AS (SELECT doc_id, owner, repo, kind, kind_no, least, i, length(b[i]) AS gap, length(w[i]) AS size, v[i] AS value
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM x WHERE len(w) > 0)),
p AS (SELECT *, SUM(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m),
f AS (SELECT doc_id, owner, repo, kind, kind_no, value, stop - size AS start, stop FROM p
      WHERE length(value) >= least AND (kind <> '{added}' OR (regexp_matches(value, '[A-Z]')
            AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')))),
o AS (SELECT value, COUNT(DISTINCT owner) AS owners, COUNT(DISTINCT (owner, repo)) AS repos FROM f GROUP BY value),
s AS (SELECT f.*, o.owners, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} THEN 'example'
             WHEN owners > 1 OR repos >= {secrets.SHARED_REPOS} THEN 'shared' ELSE 'live' END AS verdict FROM f JOIN o USING (value)
      WHERE kind <> '{added}' OR (owners = 1 AND NOT EXISTS (
        SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.kind <> '{added}' AND g.start < f.stop AND f.start < g.stop))),
r AS (SELECT doc_id, {counts},
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no)
               FILTER (kind <> '{added}') AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans,
             COUNT(*) FILTER (verdict = 'example') AS n_example,
             COUNT(*) FILTER (verdict = 'shared') AS n_shared, COUNT(*) FILTER (verdict = 'live') AS n_live
      FROM s GROUP BY doc_id)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_example, 0) AS n_example,
       COALESCE(n_shared, 0) AS n_shared, COALESCE(n_live, 0) AS n_live
FROM d LEFT JOIN r USING (doc_id)"""


def window_sql() -> str:
    """op13: windows of items against all windows of as many words of each document."""
    words = (r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    width = wumanber.WIDTH
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k
            FROM (SELECT *, least({width}, len(w)) AS n FROM i WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
x AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k
            FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT r, k, n, item_id FROM x JOIN p USING (n, win)),
c AS (SELECT r, COUNT(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) GROUP BY r),
s AS (SELECT r, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)"""


def _finite(scale: str) -> str:
    """floor(scale * x) of the components, where none is null or non-finite."""
    return (f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v "
            "FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, "
            "lambda x: x IS NOT NULL AND isfinite(x)))")


def centroid_sql() -> str:
    """op11: the rounds unrolled over (vector, dimension) rows."""
    dim = threshold.DIM

    def assigned(n: int) -> str:
        return f"""
q{n} AS MATERIALIZED (SELECT r, c, SUM((x.x - c.x) * (x.x - c.x)) AS e FROM x JOIN c{n} c USING (d) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, c, e FROM q{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY e, c) = 1)"""

    rounds = ",".join(f"""{assigned(n)},
m{n} AS (SELECT c, d, SUM(x) AS s, COUNT(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, d),
c{n + 1} AS MATERIALIZED (SELECT c, d, COALESCE((s - ((s % n) + n) % n) // n, c{n}.x) AS x
                          FROM c{n} LEFT JOIN m{n} USING (c, d))""" for n in range(threshold.ROUNDS))
    last = threshold.ROUNDS
    return f"""
WITH k AS (SELECT vec_id, {_finite(str(threshold.SCALE))}),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || COALESCE(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS r,
                          vec_id, v FROM k WHERE len(v) = {dim}),
x AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS d, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (SELECT r AS c, d, x FROM x WHERE r < {threshold.K}),{rounds},{assigned(last)},
i AS (SELECT c, SUM(e) AS ci FROM a{last} GROUP BY c),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(e AS BIGINT) AS distance, CAST(ci AS BIGINT) AS cluster_inertia,
       CAST((SELECT SUM(e) FROM a{last}) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN i USING (c) JOIN h USING (c)"""


def negative_sql() -> str:
    """op12: all rows scored for each anchor."""
    top, low = angular.TOP, angular.LOW
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, len(v) AS n, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
           FROM (SELECT vec_id, label, {_finite(str(angular.SCALE))} AND label IS NOT NULL)),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, x.r AS r, x.vec_id AS vec_id, a.label = x.label AS same,
             CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
      FROM e a JOIN e x ON a.n = x.n AND a.r <> x.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= {top}),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, x.vec_id AS negative_id, p.score AS positive_score,
             x.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.r ORDER BY x.score DESC, x.vec_id, x.r) AS rank
      FROM p JOIN s x ON p.a = x.a AND NOT x.same AND {low} * p.score <= 100 * x.score AND x.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM w WHERE rank <= {top}"""
