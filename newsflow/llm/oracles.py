"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

OP1 = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents AS d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS r USING (doc_id)
"""

_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_PLAIN_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_PLAIN_WORD}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + 9), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS phrase
  FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
    FROM d, sizes WHERE len(w) >= size
  )
),
hits AS (SELECT doc_id, item_id, p, dw.size FROM dw JOIN iw ON dw.size = iw.size AND dw.phrase = iw.phrase),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hits))
  GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS joined
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = rf"""
WITH
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM d GROUP BY source
),
w AS (SELECT *, [5, 2, 1][number % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
levels AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level
  FROM w
  WINDOW earlier AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, number, source_size,
    least(cap::DOUBLE, weight * (
      SELECT arg_min(level, cap / weight) FROM (
        SELECT level, cap, weight FROM levels WHERE level * weight <= cap))) AS target
  FROM levels
),
total AS (SELECT sum(source_size)::BIGINT AS words, greatest(1, least(4096, sum(source_size) // 131072))::BIGINT AS block FROM s),
bounds AS (
  SELECT number, least(sum(target) OVER (ORDER BY number) / words::DOUBLE, 1.0) AS high FROM t, total WHERE target > 0
),
intervals AS (
  SELECT number, coalesce(lag(high) OVER (ORDER BY number), 0.0) AS low,
    CASE WHEN number = max(number) OVER () THEN 1.0 ELSE high END AS high
  FROM bounds
),
slots AS (
  SELECT i, (i * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS point
  FROM (SELECT unnest(range(0, (words + block - 1) // block)) AS i FROM total)
),
owned AS (
  SELECT number, count(*)::BIGINT AS slots FROM slots JOIN intervals ON point >= low AND point < high GROUP BY number
),
laid AS (
  SELECT d.*, t.number, t.source_size, t.target,
    sum(size) OVER (PARTITION BY t.number ORDER BY md5(doc_id::VARCHAR), doc_id) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  coalesce((
    SELECT sum(greatest(0, least(size, coalesce(slots, 0) * block - e * source_size - start)))
    FROM (SELECT unnest([0, 1, 2]) AS e)
  ), 0)::BIGINT AS taken
FROM laid LEFT JOIN owned USING (number), total
"""

OP11 = rf"""
WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
  )
  GROUP BY lang, m, phrase
),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
    ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
  JOIN grams AS l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN grams AS r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(a) AS longer
  FROM (
    SELECT lang, w, a, size, unnest(range(1, m - size + 2)) AS i
    FROM candidates, (SELECT unnest([2, 3]) AS size) WHERE size < m
  )
  GROUP BY 1, 2
),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op6_decontamination": OP6, "op8_mixing": OP8, "op11_collocations": OP11}
