"""Personal data, vector codes and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import assert_same
from fixtures import ids_and_texts, key, odd_documents, sentence
from tokenizers import pre_tokenizers
from trovelight.llm import pii, registry, resampling, vector_codes

# personal data


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


BRUTE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only_digits(s)) <= 19 and luhn(only_digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only_digits(s)) <= 15),
]


def brute_base(text):
    return [(k, m.start(), m.end()) for k, pattern, fits in BRUTE for m in re.finditer(pattern, text or "") if fits(m[0])]


def card(rng, n=16):
    body = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def soup(rng, n):
    atoms = ["a.b@c.d", "@", ".", "1.2.3.4", "999.1.2.3", "+1 (555) 010-9999", "+", " ", "-", "é", "日", "x", "7", "12", "\n", "(", ")", "%", "_", card(rng), card(rng, 19)[:10] + " ", "256.0.0.01"]
    return "".join(rng.choice(atoms) for _ in range(n))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [soup(rng, rng.randrange(1, 60)) for _ in range(400)] + [None, "", "a@b.c_x@d.ef", "x@y.z@q.r", "1.2.3.4.5.6.7.8", "😀 a@b.c 😀", soup(rng, 5000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(docs, kinds=pii.BASE).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_long_texts_of_one_character_class_take_linear_time(spark):
    n = 1_000_000
    texts = ["a" * n, "a@" + "b." * (n // 2), "1" * n, "1." * n, "1 " * n, "+1" + "(" * n, "+1 " * n, "A1" * n, "a@b.c " * 20_000, "DE89370400440532013000" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in registry.pii_digest(pii.find_pii(docs)).collect()}
    assert len(rows) == len(texts) and rows[8]["n_email"] == 20_000
    assert rows[8]["spans"].startswith("email:0:5,email:6:11") and rows[8]["spans"].endswith(f"email:{6 * 19_999}:{6 * 19_999 + 5}")
    assert rows[1]["spans"] == f"email:0:{n + 1}"


def test_checks_and_words_near_by_decide_added_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "DE89370400440532013000", "DE89370400440532013001", "my ssn is 123-45-6789", "part 123-45-6789", "visa 378282246310005, ok", "no 378282246310005, ok", "visa 378282246310006", "call (555) 010-9999 now", "call +1 (555) 010-9999 now", "we met 555-010-9999", "xDE89370400440532013000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["value"], s["score"]) for s in r["spans"]] for r in pii.find_pii(docs).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)] and got[1] == [("iban", "DE89370400440532013000", 0.7)]
    assert got[3] == [("national_id", "123-45-6789", 0.8)] and got[5] == [("short_card", "378282246310005", 0.7)]
    assert got[8] == [("local_phone", "(555) 010-9999", 0.7)] and [s[0] for s in got[9]] == ["phone"]
    assert not any(got[i] for i in (2, 4, 6, 7, 10, 11))


def test_odd_documents_have_one_row_each(spark):
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.find_pii(docs, kinds=pii.BASE).collect()), key=key)
    assert got == sorted(((k, brute_base(t)) for k, t in ids_and_texts(docs)), key=key)
    assert registry.pii_digest(pii.find_pii(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        pii.find_pii(docs, kinds=(pii.BASE[0], pii.BASE[0]))


@pytest.mark.parametrize("name", ["op11_pii", "op12_vector_codes"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_no_python_in_the_plan_of_personal_data(spark, sf_dir):
    plan = registry.op11_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# vector codes


def brute_codes(rows, n_parts, n_entries, rounds):
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    d = width // n_parts
    parts = [[r[1][p * d : p * d + d] for p in range(n_parts)] for r in kept]
    books = [[parts[i][p] for i in range(min(n_entries, len(kept)))] for p in range(n_parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x[p], books[p][e], strict=True)), e)) for p in range(n_parts)] for x in parts]

    for _ in range(rounds):
        chosen = assign()
        for p in range(n_parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, c in zip(parts, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    chosen = assign()
    errors = [sum(sum((a - b) ** 2 for a, b in zip(x[p], books[p][c[p]], strict=True)) for p in range(n_parts)) for x, c in zip(parts, chosen, strict=True)]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{i:02x}" for i in c), e, by_label[r[2]], sha) for r, c, e in zip(kept, chosen, errors, strict=True)]


def vectors(seed, n, d, coarse=False):
    rng = np.random.default_rng(seed)
    values = rng.integers(-2, 3, (n, d)) / 4 if coarse else rng.normal(size=(n, d)).astype(np.float32)
    return [(int(i), [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(values)]


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_equal_brute_force(spark, monkeypatch, coarse):
    nan, inf = math.nan, math.inf
    rows = vectors(1, 300, 12, coarse)
    rows += [(400, None, 1), (401, [], 1), (402, [1.0] * 11 + [None], 2), (403, [nan] * 12, 2), (404, [0.0] * 11 + [inf], 3), (405, [0.5] * 8, 3), (7, rows[7][1], 1), (7, rows[7][1], 1), (None, [0.25] * 12, None)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, error string").repartition(5)
    want = sorted(brute_codes(rows, 4, 16, 2), key=key)
    for most in (50_000, 1):  # with sums broadcast, and for one label only
        monkeypatch.setattr(vector_codes, "COMMON_LABELS", most)
        got = vector_codes.vector_codes(frame, n_parts=4, n_entries=16)
        assert sorted(map(tuple, got.collect()), key=key) == want


def test_few_and_no_vectors(spark):
    rows = vectors(2, 3, 4)
    schema = "vec_id long, embedding array<double>, label int"
    got = vector_codes.vector_codes(spark.createDataFrame(rows, schema), n_parts=2, n_entries=8)
    assert sorted(map(tuple, got.collect())) == sorted(brute_codes(rows, 2, 8, 2))
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame(rows, schema), n_parts=3)


def test_equal_average_search_equals_a_full_search():
    rng = np.random.default_rng(3)
    for d, high in ((1, 5), (3, 4), (4, 300), (8, 2)):
        book, parts = rng.integers(-high, high, (40, d)), rng.integers(-high, high, (500, d))
        far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        index, dist = vector_codes.equal_average_search(parts, book)
        assert (index == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()


# importance resampling


def brute_words(text):
    lowered = (text or "").encode().lower().decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_features(text, n=10_000):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent, min_words, n=10_000):
    each = [brute_features(t) for _, t in docs]
    s, t = [0] * n, [0] * n
    for row in each:
        for b in row:
            s[b] += 1
    for text in target:
        for b in brute_features(text):
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in range(n)]
    out = []
    for (k, text), row in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in row)
        out.append([k, len(brute_words(text)), len(row), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1], r[3]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=key)


def test_query_equals_brute_force(spark, sf_dir):
    docs = ids_and_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(map(tuple, registry.op13_importance_resampling(spark, sf_dir).collect()), key=key)
    assert got == sorted(((r[0], *r[2:]) for r in brute_resample(docs, target, 5, 20)), key=key)


@pytest.mark.parametrize("run_rows, equal", [(50_000, 4096), (3, 2)])
def test_odd_documents_are_drawn_as_by_brute_force(spark, monkeypatch, run_rows, equal):
    monkeypatch.setattr(resampling, "RUN_ROWS", run_rows)
    monkeypatch.setattr(resampling, "EQUAL_ROWS", equal)
    docs = odd_documents(spark)
    long_word = spark.createDataFrame([(50, "Ü" * 300 + " x" * 30), (51, sentence(random.Random(1), 60_000)), (52, "y" * 40_000 + " z" * 25), *[(60, "same Old words " * 9)] * 40], "doc_id long, text string")
    docs = docs.unionByName(long_word, allowMissingColumns=True)
    target = spark.createDataFrame([(None,), ("",), (sentence(random.Random(9), 50),)], "text string")
    got = resampling.importance_resample(docs, target, percent=60)
    want = brute_resample(ids_and_texts(docs), [r["text"] for r in target.collect()], 60, 20)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = resampling.importance_resample(docs, docs.limit(0)).collect()
    assert [r["rank"] for r in got] == [None, None] and sorted(r["n_features"] for r in got) == [0, 3]
    assert resampling.importance_resample(docs.limit(0), docs).count() == 0


def test_words_and_offsets_come_from_the_split():
    split = resampling.splitter()
    assert isinstance(split, pre_tokenizers.Split)
    text = resampling.lowered("Été, A1 b\x7f" + "word " * 9000 + "日本")
    spans = resampling.word_spans(split, text)
    assert [text[a:b].decode() for a, b in spans] == brute_words(text.decode())
