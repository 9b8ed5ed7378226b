"""DuckDB SQL of the document operators that SQL expresses."""

OP7_SQL = r"""
WITH cap AS (
  SELECT page_id, url,
    CAST(make_timestamp((1704067200 + CAST('0x' || substr(md5('at' || CAST(page_id AS VARCHAR)), 1, 6) AS BIGINT) % 31536000) * 1000000) AS TIMESTAMP) AS fetched_at
  FROM pages
), part AS (
  SELECT DISTINCT url,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    [s FOR s IN string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') IF s <> ''] AS seg
  FROM pages WHERE url IS NOT NULL
), keyed AS (
  SELECT url, 'host' AS kind, host AS pattern FROM part WHERE host <> ''
  UNION ALL
  SELECT url, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM (SELECT url, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM part WHERE host <> '')
  UNION ALL
  SELECT url, 'prefix', host || '/' || array_to_string(list_slice(seg, 1, i), '/')
  FROM (SELECT url, host, seg, unnest(range(1, len(seg) + 1)) AS i FROM part WHERE host <> '')
), chosen AS (
  SELECT kind, pattern,
    CAST('0x' || substr(md5(kind || ':' || pattern), 1, 6) AS BIGINT) AS h,
    CAST('0x' || substr(md5(kind || ':' || pattern || 'x'), 1, 6) AS BIGINT) % 3 AS x
  FROM (SELECT DISTINCT kind, pattern FROM keyed)
), listed AS (
  SELECT kind, pattern, CAST(h % 250 AS INTEGER) AS d, x FROM chosen
  WHERE (kind = 'host' AND h % 4 = 0)
     OR (kind = 'domain' AND regexp_matches(pattern, '\..*\.') AND h % 5 = 0)
     OR (kind = 'prefix' AND h % 7 = 0)
), spans AS (
  SELECT kind, pattern, DATE '2024-01-01' + d AS a, CASE WHEN x > 0 THEN DATE '2024-01-01' + (d + 40) END AS b FROM listed
  UNION ALL
  SELECT kind, pattern, DATE '2024-01-01' + (d + 90), NULL FROM listed WHERE x > 1
), found AS (
  SELECT c.page_id, count(*) AS n_rules, min(s.kind || ':' || s.pattern) AS rule,
    arg_min(s.a, s.kind || ':' || s.pattern) AS listed_since
  FROM cap c JOIN keyed k ON c.url = k.url
  JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern
    AND s.a <= CAST(c.fetched_at AS DATE) AND (s.b IS NULL OR CAST(c.fetched_at AS DATE) < s.b)
  GROUP BY c.page_id
)
SELECT c.page_id, c.url, c.fetched_at, f.n_rules IS NOT NULL AS blocked,
  coalesce(f.n_rules, 0) AS n_rules, f.rule, CAST(f.listed_since AS DATE) AS listed_since
FROM cap c LEFT JOIN found f ON c.page_id = f.page_id
"""

OP9_SQL = r"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), seen AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text,
    CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system') p
    ON s.conv_id = p.conv_id
), headed AS (
  SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM seen
), sized AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized
)
SELECT conv_id, perspective, turn, speaker, role, segment, start,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS trained_from,
  start + length(segment) AS "end"
FROM placed
"""

OP12_SQL = r"""
WITH doc AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), piece AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')), '[^ \t]+') AS w FROM doc
), gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, 6)) AS k))
), f AS (
  SELECT lang, g, k, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w)) AS n FROM piece GROUP BY lang
), cand AS (
  SELECT c.lang, c.g, c.k, c.f FROM f c WHERE c.k > 1 AND NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.f >= 100 * c.f
      AND contains(' ' || b.g || ' ', ' ' || c.g || ' '))
), cut AS (
  SELECT c.lang, c.g, c.f AS a, j, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(string_split(c.g, ' ')[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(string_split(c.g, ' ')[j + 1:], ' ')
  JOIN total t ON t.lang = c.lang
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM low QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH word AS (
  SELECT doc_id, row_number() OVER () AS d,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), whole AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM word WHERE len(w) > 0
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY ALL
), posting AS (
  SELECT d, doc_id, n, term, count(*) AS tf
  FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM word)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM posting, whole GROUP BY term, n_docs
), scored AS (
  SELECT a.item_id, p.d, p.doc_id,
    sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * n_docs) // n_words)))) AS score
  FROM asked a JOIN posting p USING (term) JOIN weight w USING (term), whole
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""
