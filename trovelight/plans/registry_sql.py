"""DuckDB SQL for the registered queries of the library's own operators."""

from __future__ import annotations

from trovelight.functions.text import BLOCK_TAGS

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)"

HTML = rf"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<script[\s\S]*?</script>', '', 'gi'), '<style[\s\S]*?</style>', '', 'gi'), '<!--[\s\S]*?-->', '', 'g'),
  '</({BLOCK_TAGS})>', chr(10) || chr(10), 'gi'), '<(br|hr)\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM pages))
"""

CHUNK_DOCUMENTS = r"""
WITH d AS (
  SELECT doc_id, p, length(p) AS n FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM documents) WHERE length(p) > 0
), c AS (
  SELECT doc_id, 0 AS i, p AS text FROM d WHERE n <= 1500
  UNION ALL SELECT doc_id, i // 1300, substr(p, i + 1, 1500) FROM (SELECT doc_id, p, unnest(range(0, n, 1300)) AS i FROM d WHERE n > 1500)
  UNION ALL SELECT doc_id, (n - 1) // 1300 + 1, right(substr(p, (n - 1) // 1300 * 1300 + 1, 1500), 200) FROM d WHERE n > 1500
)
SELECT doc_id || '#' || i AS chunk_id, doc_id::VARCHAR AS source, i::INT AS chunk_index, text FROM c
"""

CHUNK_PAGES = rf"""
WITH RECURSIVE h AS ({HTML}), p AS (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 0) AS ps FROM h
), f AS (
  SELECT page_id, ps, 0 AS i, []::VARCHAR[] AS outs, '' AS cur, 0::BIGINT AS size FROM p
  UNION ALL
  SELECT page_id, ps, i + 1,
    CASE WHEN length(x) > 1500 THEN (CASE WHEN size > 0 THEN list_append(outs, cur) ELSE outs END) || list_transform(range(0, length(x), 1300), lambda j: substr(x, j + 1, 1500))
         WHEN size > 0 AND size + length(x) > 1500 THEN list_append(outs, cur) ELSE outs END,
    CASE WHEN length(x) > 1500 THEN right(substr(x, (length(x) - 1) // 1300 * 1300 + 1, 1500), 200)
         WHEN size > 0 AND size + length(x) > 1500 THEN right(cur, 200) || chr(10) || chr(10) || x
         WHEN size = 0 THEN x ELSE cur || chr(10) || chr(10) || x END,
    CASE WHEN length(x) > 1500 THEN length(right(substr(x, (length(x) - 1) // 1300 * 1300 + 1, 1500), 200))
         WHEN size > 0 AND size + length(x) > 1500 THEN length(right(cur, 200)) + length(x) + 2 ELSE size + length(x) + 2 END
  FROM (SELECT *, ps[i + 1] AS x FROM f WHERE i < len(ps))
), e AS (
  SELECT page_id, CASE WHEN size > 0 THEN list_append(outs, cur) ELSE outs END AS outs FROM f WHERE i = len(ps)
), u AS (SELECT page_id, unnest(range(0, len(outs))) AS i, outs FROM e)
SELECT page_id || '#' || i AS chunk_id, page_id::VARCHAR AS source, i::INT AS chunk_index, outs[i + 1] AS text FROM u
"""

_POSTINGS = f"""SELECT doc_id AS id, term, count(*) AS tf, dl FROM (
  SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents)) GROUP BY doc_id, term, dl"""


def _bm25(questions: str, k: int) -> str:
    return f"""SELECT qid, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (
    SELECT qid, p.id, round(sum(qtf * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TOKENS}) AS term FROM ({questions})) GROUP BY ALL) q
    JOIN postings p USING (term) JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term)
    CROSS JOIN (SELECT count(*) AS n, avg(len({_TOKENS})) AS avgdl FROM documents) GROUP BY qid, p.id) WHERE score > 0)
  WHERE rank <= {k}"""


def _knn(asked: str, k: int) -> str:
    return f"""SELECT qid, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (
    SELECT qid, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS score FROM embeddings, ({asked}))) WHERE rank <= {k}"""


def _fuse(lists: list[str], k: int) -> str:
    rows = " UNION ALL ".join(f"SELECT qid, id, rank, {i} AS list_no FROM ({x})" for i, x in enumerate(lists))
    return f"""SELECT qid, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen)::INT AS rank FROM (
    SELECT qid, id, round(sum(1 / (60 + rank)), 12) AS score, min(list_no * 1000000 + rank) AS seen FROM ({rows}) GROUP BY qid, id)) WHERE rank <= {k}"""


_QUESTIONS = "SELECT item_id AS qid, text FROM benchmark"
_QUESTION_VECTORS = "SELECT item_id AS qid, e.embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings e ON vec_id = item_id"
_WITH = f"WITH postings AS MATERIALIZED ({_POSTINGS})"


def _hybrid(k: int) -> str:
    return _fuse([_knn(_QUESTION_VECTORS, 20), _bm25(_QUESTIONS, 20)], k)


_BUDGET = f"""WITH RECURSIVE postings AS MATERIALIZED ({_POSTINGS}), found AS MATERIALIZED (
  SELECT qid, id, rank, ceil(length(text) / 4)::BIGINT AS cost FROM ({_hybrid(20)}) JOIN documents ON doc_id = id
), walk AS (
  SELECT qid, 0 AS spot, 0::BIGINT AS used, NULL::BIGINT AS id, NULL::BIGINT AS cost, false AS kept FROM (SELECT DISTINCT qid FROM found)
  UNION ALL
  SELECT w.qid, f.rank, CASE WHEN used + f.cost <= 1800 THEN used + f.cost ELSE used END, f.id, f.cost, used + f.cost <= 1800
  FROM walk w JOIN (SELECT *, lag(rank, 1, 0) OVER (PARTITION BY qid ORDER BY rank) AS prev FROM found) f ON f.qid = w.qid AND f.prev = w.spot
), budget AS (SELECT qid, id, spot::INT AS rank, cost FROM walk WHERE kept)"""
_ORDER = """SELECT qid, id, rank, (CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END + 1)::INT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, id) - 1 AS i, count(*) OVER (PARTITION BY qid) AS n FROM budget)"""
_LINES = "string_split(text, chr(10))"
_RUNS = f"""{_WITH}, cases AS MATERIALIZED (
  SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON len(regexp_split_to_array(b.text, '\\s+')) > 5 AND contains(d.text, b.text)
), runs AS (SELECT 'bm25' AS strategy, * FROM ({_bm25(_QUESTIONS, 6)}) UNION ALL SELECT 'hybrid', * FROM ({_hybrid(6)})),
ranks AS (
  SELECT s.strategy, c.qid, min(r.rank) AS first_rank FROM (SELECT DISTINCT strategy FROM runs) s CROSS JOIN cases c
  LEFT JOIN runs r ON r.strategy = s.strategy AND r.qid = c.qid AND r.id = c.doc_id GROUP BY ALL
)"""
_STOP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TRIMMED = """SELECT conv_id, turn, role FROM (SELECT *, sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM conversations) WHERE rest <= 150"""

_REPLIES = """
SELECT reply, content FROM (
  SELECT conv_id || '-' || turn AS reply, array_to_string(list_transform(parts[1:len(parts) - turn % 2], lambda x: x || '. '), '') AS content
  FROM (SELECT conv_id, turn, string_split(text, '. ') AS parts FROM conversations WHERE text IS NOT NULL))
WHERE content <> ''
"""

_GAPS = "'[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+'"


def _vectors(texts: str) -> str:
    """The hashed bag of words of (id, text) rows, as (id, d, x) rows of what is not 0."""
    return f"""SELECT id, d, (v / sqrt(sum(v * v) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM (
    SELECT id, ('0x' || h[1:8])::BIGINT % 384 AS d, sum(CASE WHEN h[9] >= '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM (
      SELECT id, md5(w) AS h FROM (SELECT id, trim(unnest(regexp_split_to_array(lower(text), {_GAPS})), '.,;:!?()[]"''') AS w FROM ({texts})) WHERE w <> '') GROUP BY ALL) WHERE v <> 0"""


_EMBEDDED = f"{_WITH}, doc_vectors AS MATERIALIZED ({_vectors('SELECT doc_id AS id, text FROM documents')})"


def _near(questions: str, k: int) -> str:
    return f"""SELECT qid, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM (
    SELECT qid, doc_id AS id, round(coalesce(s, 0), 6) AS score FROM ({questions}) CROSS JOIN (SELECT doc_id FROM documents)
    LEFT JOIN (SELECT q.id AS qid, d.id AS doc_id, sum(q.x * d.x) AS s FROM ({_vectors(f"SELECT qid AS id, text FROM ({questions})")}) q JOIN doc_vectors d USING (d) GROUP BY ALL) USING (qid, doc_id))) WHERE rank <= {k}"""


def _both(questions: str, k: int) -> str:
    return _fuse([_near(questions, 20), _bm25(questions, 20)], k)


_FIRST, _LAST = (f"SELECT qid, array_to_string(string_split(text, ' ')[{part}], ' ') AS text FROM asked" for part in ("1:2", "-2:"))
_RERANKED = f"""SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before)::INT AS rank FROM (
  SELECT qid, id, rank AS before, round(1 / (1 + exp(-(4 * coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0) - 2))), 6) AS score FROM (
    SELECT h.*, (SELECT list_distinct({_TOKENS}) FROM asked a WHERE a.qid = h.qid) AS q, (SELECT {_TOKENS} FROM documents WHERE doc_id = h.id) AS t FROM ({_both("SELECT * FROM asked", 20)}) h))"""
_STRATEGIES = f"""{_EMBEDDED}, cases AS MATERIALIZED (
  SELECT item_id AS qid, array_to_string(regexp_split_to_array(b.text, '\\s+')[3:5], ' ') AS text, doc_id FROM benchmark b JOIN documents d ON len(regexp_split_to_array(b.text, '\\s+')) > 5 AND contains(d.text, b.text)
), asked AS MATERIALIZED (SELECT DISTINCT qid, text FROM cases), runs AS MATERIALIZED (
  SELECT 'vector' AS strategy, qid, id, rank FROM ({_near("SELECT * FROM asked", 6)})
  UNION ALL SELECT 'bm25', qid, id, rank FROM ({_bm25("SELECT * FROM asked", 6)})
  UNION ALL SELECT 'hybrid', qid, id, rank FROM ({_both("SELECT * FROM asked", 6)})
  UNION ALL SELECT 'rerank', qid, id, rank FROM ({_RERANKED}) WHERE rank <= 6
  UNION ALL SELECT 'hyde', qid, id, rank FROM ({_near(_LAST, 6)})
  UNION ALL SELECT 'multi_query', qid, id, rank FROM ({_fuse([_both("SELECT * FROM asked", 20), _both(_FIRST, 20), _both(_LAST, 20)], 6)})
), ranks AS (
  SELECT s.strategy, c.qid, min(r.rank) AS first_rank FROM (SELECT DISTINCT strategy FROM runs) s CROSS JOIN cases c
  LEFT JOIN runs r ON r.strategy = s.strategy AND r.qid = c.qid AND r.id = c.doc_id GROUP BY ALL
)"""

SQL = {
    "html_to_text": HTML,
    "chunk_documents": CHUNK_DOCUMENTS,
    "chunk_pages": CHUNK_PAGES,
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "term_freq": _POSTINGS,
    "doc_freq": f"SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl FROM documents",
    "token_estimate": "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents",
    "loader_dispatch": r"""SELECT page_id, CASE WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ('.pdf', '.docx', '.csv') THEN ext[2:]
      WHEN ext IN ('.md', '.mdx', '.txt', '.rst', '.ts', '.tsx', '.js', '.jsx', '.py', '.go', '.rb', '.java', '.cs', '.php', '.json', '.yaml', '.yml', '.toml', '.css', '.sql', '.sh') THEN 'text' END AS loader
      FROM (SELECT page_id, lower(regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '[^/](\.[^./]+)$', 1)) AS ext FROM pages)""",
    "bm25_batch": f"{_WITH} {_bm25(_QUESTIONS, 20)}",
    "bm25_segments": f"{_WITH} {_bm25(_QUESTIONS, 20)}",
    "vector_batch": _knn("SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0", 10),
    "vector_norms": """SELECT id, round(list_dot_product(u, u), 6) AS length, round(u[1], 6) AS first FROM (
      SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)""",
    "rrf_hybrid": f"{_WITH} {_hybrid(20)}",
    "rrf_multi_query": f"{_WITH} " + _fuse([_bm25(q, 20) for q in (_QUESTIONS, f"SELECT item_id AS qid, {_LINES}[1] AS text FROM benchmark", f"SELECT item_id AS qid, {_LINES}[-1] AS text FROM benchmark")], 10),
    "hybrid_reranked": f"""{_WITH} SELECT qid, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before)::INT AS rank FROM (
        SELECT qid, id, rank AS before, round(1 / (1 + exp(-(4 * coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0) - 2))), 6) AS score FROM (
          SELECT h.*, (SELECT list_distinct({_TOKENS}) FROM benchmark WHERE item_id = qid) AS q, (SELECT {_TOKENS} FROM documents WHERE doc_id = h.id) AS t FROM ({_hybrid(20)}) h WHERE h.id IN (SELECT doc_id FROM documents)))) WHERE rank <= 6""",
    "budget_select": f"{_BUDGET} SELECT * FROM budget",
    "context_order": f"{_BUDGET} {_ORDER}",
    "context_prompt": f"""{_BUDGET} SELECT qid, md5(string_agg('[' || position || '] (source: ' || id || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position)) AS context_md5,
      string_agg(id::VARCHAR, ',' ORDER BY position) AS ids FROM ({_ORDER}) JOIN documents ON doc_id = id GROUP BY qid""",
    "search_report": rf"""{_WITH} SELECT qid, rank, printf('[%.4f] %s', floor(score * 10000 + 0.5) / 10000, id::VARCHAR) AS head, regexp_replace(substr(text, 1, 300), '\s+', ' ', 'g') || '…' AS body
      FROM ({_bm25(_QUESTIONS, 20)}) JOIN documents ON doc_id = id""",
    "distinct_sources": f"""{_WITH}, f AS (SELECT qid, source, min(rank) AS r, count(*) AS c FROM ({_bm25(_QUESTIONS, 20)}) JOIN documents ON doc_id = id GROUP BY qid, source)
      SELECT qid, sum(c)::BIGINT AS n, string_agg(source, ', ' ORDER BY r) AS sources FROM f GROUP BY qid""",
    "citations": r"""WITH a AS (SELECT conv_id || '-' || turn AS qid, conv_id, list_distinct(list_transform(regexp_extract_all(text || printf(' [%d]. [%d][1] [%d] [1, 3]', turn + 2, turn % 3, conv_id % 9), '\[(\d+)\]', 1), lambda x: try_cast(x AS BIGINT))) AS ns FROM conversations)
      SELECT qid, n, 'c' || n || '-' || conv_id AS id FROM (SELECT qid, conv_id, unnest(ns) AS n FROM a) WHERE n BETWEEN 1 AND 5""",
    "history_trim": _TRIMMED,
    "vector_embedded": f"{_EMBEDDED} {_near(_QUESTIONS, 20)}",
    "hybrid_embedded": f"{_EMBEDDED} {_both(_QUESTIONS, 20)}",
    "eval_strategies": f"""{_STRATEGIES} SELECT strategy, {", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}" for k in (1, 3, 6))}, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM ranks GROUP BY strategy""",
    "eval_strategy_misses": f"""{_STRATEGIES} SELECT text, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS expected FROM ranks JOIN cases USING (qid) WHERE strategy = 'hybrid' AND first_rank IS NULL GROUP BY qid, text""",
    "history_stream": _TRIMMED,
    "csv_splits": """SELECT 'key: ' || c_custkey || chr(10) || 'remark: seen, "' || c_name || '"' || chr(10) || c_mktsegment || chr(10) || 'nation: ' || c_nationkey AS text FROM customer""",
    "reply_contents": _REPLIES,
    "reply_stream": _REPLIES,
    "first_turns": f"SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM ({_TRIMMED}) GROUP BY conv_id",
    "history_transcript": "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "eval_metrics": _RUNS + " SELECT strategy, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 6)) + ", round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM ranks GROUP BY strategy",
    "eval_misses": _RUNS + " SELECT strategy, qid FROM ranks WHERE first_rank IS NULL",
    "variant_lines": rf"""SELECT doc_id, array_to_string(list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace(x, '^[\s\d.\-*)]+', ''), {_STOP})), lambda x: length(x) > 0)[1:3], '|') AS variants FROM documents""",
    "csv_records": """SELECT c_custkey || ':row2' AS source, 'name: ' || c_name || ', "x"' || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'nation: ' || c_nationkey AS text FROM customer""",
}
