"""DuckDB SQL for the queries that SQL can express: plain joins of windows and of shingles."""

from __future__ import annotations

from tagsmith.llm import urls

# A-Z in lower case, and nothing else
_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"coalesce(regexp_extract_all({_TEXT}, '{pattern}'), [])"


_ALPHANUMERIC, _SPACED = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), _words(r"[^\x20\x09-\x0D]+")

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALPHANUMERIC} AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS k, i, w, least(10, len(w)) AS size
  FROM (SELECT CAST(item_id AS VARCHAR) AS i, {_ALPHANUMERIC} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
iw AS (
  SELECT k, i, size, unnest(range(1, len(w) - size + 2)) AS q,
    unnest([array_to_string(w[x:x + size - 1], ' ') FOR x IN range(1, len(w) - size + 2)]) AS win FROM items),
dw AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS p,
    unnest([array_to_string(w[x:x + size - 1], ' ') FOR x IN range(1, len(w) - size + 2)]) AS win
  FROM d, (SELECT DISTINCT size FROM items) WHERE len(w) >= size),
m AS (SELECT r, p, k, i, q, size FROM dw JOIN iw USING (size, win)),
hits AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS x FROM (SELECT DISTINCT r, p, size FROM m)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i FROM m) GROUP BY r),
runs AS (
  SELECT r, k, q - p AS shift, count(*) + max(size) - 1 AS n
  FROM (SELECT *, p - row_number() OVER (PARTITION BY r, k, q - p ORDER BY p) AS island FROM m) GROUP BY r, k, q - p, island),
longest AS (SELECT r, max(n) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hits USING (r) LEFT JOIN ids USING (r) LEFT JOIN longest USING (r)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED} AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(
    [array_to_string(w[x:x + 3], ' ') FOR x IN range(1, greatest(len(w) - 3, 1) + 1)])) END AS grams FROM d),
sets AS (SELECT min(r) AS c, min(doc_id) AS least, grams, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
x AS (SELECT c, n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.c AS u, b.c AS v FROM x AS a JOIN x AS b ON a.gram = b.gram AND a.c <> b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT u AS a, u AS b FROM links UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u),
known AS (
  SELECT sets.grams, coalesce(min(o.least), sets.least) AS component
  FROM sets LEFT JOIN reach ON reach.a = sets.c LEFT JOIN sets AS o ON o.c = reach.b GROUP BY sets.grams, sets.least)
SELECT doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM s LEFT JOIN known ON s.grams = known.grams"""


COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (
  SELECT lang, k, unnest([array_to_string(w[x:x + k - 1], ' ') FOR x IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY lang, phrase, k),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.f AS l, r.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f AS l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:cut], ' ') AND l.k = cut
  JOIN f AS r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') AND r.k = cuts.k - cut),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[x:x + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": DECONTAMINATION,
        "op5_ngram_jaccard_join": NGRAM_JOIN,
        "op11_collocations": COLLOCATIONS,
        "op10_url_filter": urls.oracle_sql(),
    }
