"""DuckDB SQL for op11_pii and op12_vector_codes."""

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""CASE WHEN length({_DIGITS}) BETWEEN {{least}} AND {{most}} THEN list_sum(list_transform(range(1, 20), lambda i:
    CASE WHEN i % 2 = 1 THEN ('0' || lpad({_DIGITS}, 19, '0')[i])::INT ELSE (ascii(lpad({_DIGITS}, 19, '0')[i]) - 48) * 2 - CASE WHEN lpad({_DIGITS}, 19, '0')[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0 ELSE false END"""
_BYTE = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"regexp_matches(v, '^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$')"
_PHONE = f"length({_DIGITS}) BETWEEN 8 AND 15"
_TURNED = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
_MOD_97 = f"list_reduce([0] || list_transform(string_split({_TURNED}, ''), lambda c: ascii(c)), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
_ALONE = r"(left_n > 0 OR i = 1) AND NOT regexp_matches(tail, '([A-Za-z0-9+-]|\+[0-9]{1,3}[ .-]?)$') AND NOT regexp_matches(head, '^[A-Za-z0-9-]')"


def _near(cues: str) -> str:
    return rf"{_ALONE} AND regexp_matches(lower(tail || ' | ' || head), '(^|[^a-z])({cues})([^a-z]|$)')"


_CARDS = "card|credit|visa|amex|mastercard|karte|tarjeta|carte"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _IP),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN.format(least=16, most=19)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _PHONE),
    ("iban", r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", f"{_ALONE} AND {_MOD_97}"),
    ("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _near("ssn|social security|tax id|itin")),
    ("short_card", r"[0-9]{13,15}", f"{_near(_CARDS)} AND {_LUHN.format(least=13, most=15)}"),
    ("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", _near("phone|tel|telephone|call|fax|mobile|cell|telefon|handy")),
]


def _spans(n: int, name: str, pattern: str, test: str) -> str:
    return f"""SELECT r, {n} AS kind_no, start, '{name}:' || start || ':' || (start + length(v)) AS span FROM (
    SELECT r, i, v, left_n, tail, head, sum(left_n + length(v)) OVER (PARTITION BY r ORDER BY i) - length(v) AS start FROM (
      SELECT r, i, m[i] AS v, length(p[i]) AS left_n, right(p[i], 40) AS tail, left(p[i + 1], 40) AS head FROM (
        SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d)))) WHERE {test}"""


PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans(n, *k) for n, k in enumerate(_KINDS))}),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind_no = {n}) AS n_{_KINDS[n][0]}" for n in range(4))},
    coalesce(string_agg(span, ',' ORDER BY kind_no, start) FILTER (kind_no < 4), '') AS base, string_agg(span, ',' ORDER BY kind_no, start) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

_FAR = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _nearest(n: int) -> str:
    return f"SELECT p.r, p.part, min(({_FAR} * 64 + entry)::HUGEINT) AS best FROM p JOIN b{n} USING (part) GROUP BY ALL"


def _round(n: int) -> str:
    return f"""a{n} AS ({_nearest(n)}),
m{n} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS e FROM (
    SELECT part, (best % 64)::BIGINT AS entry, pos, floor(sum(x[pos])::DOUBLE / count(*))::BIGINT AS mean
    FROM a{n} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL
), b{n + 1} AS (SELECT part, entry, coalesce(m{n}.e, b{n}.e) AS e FROM b{n} LEFT JOIN m{n} USING (part, entry))"""


CODES = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (SELECT r, part, list_slice(v, part * len(v) // 16 + 1, (part + 1) * len(v) // 16) AS x FROM v, unnest(range(16)) AS u(part)),
b0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= 64),
{_round(0)},
{_round(1)},
a2 AS ({_nearest(2)}),
c AS (SELECT r, string_agg(printf('%02x', (best % 64)::BIGINT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY r),
k AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), k
"""
