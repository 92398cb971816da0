"""DuckDB SQL for op10_quality_rules."""

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), toks AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM toks WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), c AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM docs d JOIN toks USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats p USING (r)
), m AS (
  SELECT r, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'length']) AS metric,
    unnest([1000 * n_symbols // word_chars, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words,
            least(100 * word_chars // n_words, 100000)]) AS bin
  FROM c WHERE n_words > 0
), grp AS (
  SELECT lang, source, metric, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM m GROUP BY ALL
), lng AS (
  SELECT lang, metric, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM m GROUP BY ALL
), al AS (
  SELECT metric, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM m GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, g.metric,
    CASE WHEN g.n >= 200 THEN g.q1 WHEN l.n >= 200 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN g.n >= 200 THEN g.q3 WHEN l.n >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM grp g JOIN lng l ON g.metric = l.metric AND g.lang IS NOT DISTINCT FROM l.lang JOIN al a ON g.metric = a.metric
), bad AS (
  SELECT DISTINCT m.r FROM m JOIN f ON m.metric = f.metric AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  WHERE bin > q3 + 3 * (q3 - q1) + CASE m.metric WHEN 'symbols' THEN 50 ELSE 100 END
     OR (m.metric = 'length' AND bin < q1 - 3 * (q3 - q1) - 100)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.r IS NULL AS kept
FROM c LEFT JOIN bad USING (r)
"""
