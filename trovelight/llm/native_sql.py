"""DuckDB SQL for op4_url_filters and op8_mix_sources."""

URLS = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages
), q AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches('.' || host, '[.-](casino(-[a-z0-9]+)*|free-bets|adult(-[a-z0-9]+)*|spam-farm)\.') THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""


def _level(name: str, source: str, keys: str, parent: str, child: str) -> str:
    over = f"PARTITION BY {parent}" if parent else ""
    order = f"{over} ORDER BY CASE WHEN weight > 0 THEN supply / weight END NULLS LAST, {child}"
    return f"""{name}_a AS (
  SELECT *, budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw, row_number() OVER ({order}) AS place
  FROM ({source})
), {name}_b AS (SELECT *, weight > 0 AND supply * lw <= weight * lt AS is_full FROM {name}_a),
{name}_c AS (
  SELECT *, min(CASE WHEN NOT is_full AND weight > 0 THEN place END) OVER ({over}) AS stop_at FROM {name}_b
), {name} AS (
  SELECT {keys}, greatest(coalesce(CASE WHEN weight = 0 THEN 0 WHEN is_full THEN supply ELSE
      max(CASE WHEN place = stop_at THEN lt END) OVER ({over}) * weight // max(CASE WHEN place = stop_at THEN lw END) OVER ({over}) END, 0), 0)::BIGINT AS budget
  FROM {name}_c
)"""


MIX = f"""
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS supply, 1::BIGINT AS weight FROM d GROUP BY ALL
), lng AS (
  SELECT domain, lang, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END::BIGINT AS weight FROM leaf GROUP BY ALL
), dom AS (
  SELECT domain, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END::BIGINT AS weight FROM lng GROUP BY ALL
), {_level("top", "SELECT *, ((SELECT sum(tokens) FROM dom) * 50 // 100)::BIGINT AS budget FROM dom", "domain", "", "domain")},
{_level("mid", "SELECT lng.*, top.budget FROM lng JOIN top USING (domain)", "domain, lang", "domain", "lang")},
{_level("low", "SELECT leaf.*, mid.budget FROM leaf JOIN mid USING (domain, lang)", "domain, lang, source, tokens", "domain, lang", "source")},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM low),
x AS (
  SELECT d.*, budget, epochs, budget - epochs * tokens AS left_over,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || doc_id), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
  (epochs + CASE WHEN upto <= left_over AND left_over > 0 THEN 1 ELSE 0 END)::BIGINT AS copies FROM x
"""
