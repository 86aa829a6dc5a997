"""DuckDB reference SQL pieces for text operators and the qa / corpus adapters."""

from rankscope.functions.text import CONTEXT_LABELS, KEPT_CHAR_CLASS, WHITESPACE_CLASS

WS = WHITESPACE_CLASS + "+"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '{WS}', ' ', 'g'))"


def context(t: str, a: str, b: str, n: int = 900) -> str:
    parts = [f"CASE WHEN {clean(v)} <> '' THEN '{lab}' || {clean(v)} END"
             for lab, v in zip(CONTEXT_LABELS, (t, a, b))]
    return f"substring(concat_ws(' ', {', '.join(parts)}), 1, {n})"


def bigrams(x: str) -> str:
    ch = f"regexp_extract_all(coalesce({x}, ''), '{KEPT_CHAR_CLASS}')"
    # the character list is never referenced inside the lambda (that would re-run the regex per element)
    return (f"(CASE WHEN len({ch}) < 2 THEN list_distinct({ch}) ELSE list_distinct("
            f"list_transform(list_zip(({ch})[1:len({ch}) - 1], ({ch})[2:]), lambda p: p[1] || p[2])) END)")


def char_set(x: str) -> str:
    return f"list_filter(list_distinct(string_split(lower({clean(x)}), '')), lambda c: c <> ' ' AND c <> '')"


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)")


QA_RAW_CTE = """
qa_raw AS (
  SELECT CASE WHEN u.conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS department,
         COALESCE(s.title, '') AS title, u.text AS ask, a.text AS answer, u.conv_id, u.turn
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS title FROM conversations WHERE role = 'system'
             GROUP BY conv_id) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""

CORPUS_RAW_CTE = f"""
corpus_raw AS (
  SELECT lang AS department, source AS title, substring({clean('text')}, 1, 120) AS ask,
         substring({clean('text')}, 121) AS answer, doc_id AS conv_id, CAST(0 AS BIGINT) AS turn
  FROM documents)"""


def load_cte(raw: str, name: str) -> str:
    """S3 over a raw CTE -> CTE `name` with the corpus columns."""
    return f"""
{name}_c AS (
  SELECT CAST(department AS VARCHAR) AS canonical_department, {clean('department')} AS department,
         {clean('title')} AS title, {clean('ask')} AS ask, {clean('answer')} AS answer, conv_id, turn
  FROM {raw}),
{name}_d AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY canonical_department, ask, answer
                                              ORDER BY conv_id, turn) AS dup
                 FROM {name}_c WHERE ask <> '' AND answer <> '') WHERE dup = 1),
{name} AS (
  SELECT canonical_department,
         printf('%s_%06d', canonical_department,
                ROW_NUMBER() OVER (PARTITION BY canonical_department ORDER BY conv_id, turn) - 1) AS raw_id,
         ROW_NUMBER() OVER (PARTITION BY canonical_department ORDER BY conv_id, turn) - 1 AS row_no,
         department, title, ask, answer, {context('title', 'ask', 'answer')} AS context,
         lower({clean('answer')}) AS answer_key
  FROM {name}_d)"""


def ngrams(t: str, n_min: int = 2, n_max: int = 4) -> str:
    """DuckDB list of all character n-grams of the prepared text ``t``."""
    parts = [f"list_transform(range(1, length({t}) - {n} + 2), lambda i: substring({t}, i, {n}))"
             for n in range(n_min, n_max + 1)]
    return "list_concat(" + ", ".join(parts) + ")"


def tfidf_ctes(docs: str, prefix: str = "tf") -> str:
    """TF-IDF over CTE `docs(k, t, m)` -> CTE `{prefix}_vec(k, g, w)`."""
    return f"""
{prefix}_pre AS (SELECT k, m, regexp_replace(lower(coalesce(t, '')), '{WHITESPACE_CLASS}{{2,}}', ' ', 'g') AS t FROM {docs}),
{prefix}_grams AS (SELECT k, m, unnest({ngrams('t')}) AS g FROM {prefix}_pre),
{prefix}_tf AS (SELECT k, m, g, COUNT(*) AS tf FROM {prefix}_grams GROUP BY k, m, g),
{prefix}_df AS (SELECT g, SUM(m) AS df FROM {prefix}_tf GROUP BY g),
{prefix}_w AS (SELECT k, g, tf * (ln((1 + (SELECT SUM(m) FROM {docs})) / (1 + df)) + 1) AS w
               FROM {prefix}_tf JOIN {prefix}_df USING (g)),
{prefix}_nrm AS (SELECT k, sqrt(SUM(w * w)) AS nrm FROM {prefix}_w GROUP BY k),
{prefix}_vec AS (SELECT k, g, w / nrm AS w FROM {prefix}_w JOIN {prefix}_nrm USING (k))"""
