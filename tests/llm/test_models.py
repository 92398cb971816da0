"""Language ID, language-model scores, toxicity."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ids_and_texts, lower_words, odd_documents

from trovelight.llm import katz, langid, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc(k, n):
    return zlib.crc32(str(k if k is not None else "").encode()) % n


def test_language_accuracy_on_the_held_out_fold(docs):
    got = langid.detect_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    judged = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(judged) > 20 and sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.95 * len(judged)


def test_language_of_odd_texts(spark):
    odd = odd_documents(spark)
    got = langid.detect_languages(odd).collect()
    assert len(got) == odd.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {4, 5, 6, 17, None} or und == {4, 5, 6, 17}
    assert langid.detect_languages(odd.limit(0)).count() == 0
    unlabelled = langid.detect_languages(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


def test_unseen_words_back_off_to_shorter_grams(spark):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("strasse strasse weg weg", "de"), ("calle calle camino camino", "es")] * 8)]
    docs = spark.createDataFrame(rows + [(100, "strassen wegx", None, None), (101, "callejo caminos", None, None), (102, "qqq", None, None)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_languages(docs).collect()}
    assert (got[100], got[101]) == ("de", "es") and got[102] in ("de", "es")


def language_brute(rows):
    """Word-first backoff in plain Python. rows: (id, text, lang)."""
    seen = lambda t: [w for w in re.split(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", t.lower().encode()) if w]
    grams = lambda w, n: [(None, *w, None)[i : i + n] for i in range(len(w) + 3 - n)]
    units = lambda w, n: [w] if n == 0 else grams(w, n)
    taught = sorted({(k, t, lang) for k, t, lang in rows if lang is not None and t is not None and crc(k, 4) != 2}, key=repr)
    langs = sorted({lang for *_, lang in taught})
    counts = [collections.defaultdict(collections.Counter) for _ in range(6)]
    for _, t, lang in taught:
        for w in seen(t):
            for n in range(6):
                for u in units(w, n):
                    counts[n][u][lang] += 1
    totals = [{x: sum(c[x] for c in table.values()) for x in langs} for table in counts]

    def log(n, u, x):
        return math.log((counts[n][u][x] + 0.1) / (totals[n][x] + 0.1 * (len(counts[n]) + 1)))

    def of_word(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [u for u in units(w, n) if u in counts[n]]
            if known:
                found = [sum(log(n, u, x) for u in known) / len(known) for x in langs]
                return [f - sum(found) / len(found) for f in found]
        return [0.0] * len(langs)

    out = []
    for k, t, _ in rows:
        words = seen(t or "")
        if not langs or not re.search(r"[^\W\d_]", t or ""):
            out.append((k, "und", 0.0))
            continue
        total = [sum(x) / math.sqrt(max(len(words), 1)) for x in zip(*map(of_word, words), strict=True)] or [0.0] * len(langs)
        p = [math.exp(x - max(total)) for x in total]
        out.append((k, langs[p.index(max(p))], max(p) / sum(p)))
    return out


def test_languages_equal_brute_force(spark, docs):
    for table in (docs.limit(60), odd_documents(spark)):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.select("doc_id", "text", "lang").collect()]
        order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        fixed = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.detect_languages(fixed).collect()), key=order)
        for g, w in zip(got, sorted(language_brute(rows), key=order), strict=True):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-4)


def test_rare_languages_are_in_the_training_sample(spark):
    rows = [(i, f"wort{i} haus", "de") for i in range(3000)] + [(9000 + i, f"mot{i} maison", "fr") for i in range(6)]
    docs = spark.createDataFrame(rows, "u long, text string, lang string")
    got = {r["lang"]: r["count"] for r in langid.training_sample(docs, 200, 1 << 20).groupBy("lang").count().collect()}
    assert got["fr"] == 6 and 60 < got["de"] < 150
    assert langid.training_sample(docs, 200, 200).count() < 40


def katz_brute(rows):
    held = [crc(k, 10) == 0 for k, _ in rows]
    seqs = [[*lower_words(t), None] for _, t in rows]
    c, b, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for s, h in zip(seqs, held, strict=True):
        if not h:
            c.update(s)
            b.update(zip(["<s>", *s[:-1]], s, strict=True))
            ctx.update(["<s>", *s[:-1]])
    total, types = sum(c.values()), len(c)
    spectrum = lambda x: np.array([sum(v == r for v in x.values()) for r in range(1, katz.K + 2)], float)
    uni, d = katz.Unigrams.of(total, types, spectrum(c)), katz.discounts(spectrum(b))
    share = lambda w: float(uni.share(np.array([c[w]]))[0])
    after = collections.defaultdict(list)
    for (u, w), r in b.items():
        after[u].append((w, r))
    seen = lambda u, r: (d[r - 1] * r if r <= katz.K else r - katz.ABOVE) / ctx[u]
    weight = {u: (1 - sum(seen(u, r) for _, r in ws)) / (1 - sum(share(w) for w, _ in ws)) for u, ws in after.items()}
    p = lambda u, w: seen(u, b[u, w]) if b[u, w] else weight.get(u, 1.0) * share(w)
    for u in list(after)[:20]:
        assert sum(p(u, w) for w in c) + weight[u] * uni.unknown == pytest.approx(1)
    out = []
    for (k, _), s, h in zip(rows, seqs, held, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (types + 1))) for w in s)
        out.append((k, h, len(s), sum(c[w] > 0 for w in s), total, base, sum(math.log10(p(u, w)) for u, w in zip(["<s>", *s[:-1]], s, strict=True))))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_katz_equals_brute_force(spark, docs, monkeypatch, small):
    if small:  # many chunks and buckets, and contexts that are spread over buckets
        monkeypatch.setattr(katz, "CHUNK_BYTES", 50_000)
        monkeypatch.setattr(katz, "BUCKET_BIGRAMS", 4_000)
    for table in (docs, odd_documents(spark)):
        order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
        got, want = sorted((tuple(r) for r in katz.katz_scores(table).collect()), key=order), sorted(katz_brute(ids_and_texts(table)), key=order)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_katz_without_texts(docs):
    assert katz.katz_scores(docs.limit(0)).count() == 0


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def insult_corpus(n, seed):
    rng = np.random.default_rng(seed)
    text = lambda m: ["".join(rng.choice(list("bdfglmnprstv")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 4))) for _ in range(m)]
    rows = []
    for i in range(n):
        w, bad = text(int(rng.integers(20, 200))), int(i % 4 == 0)
        for _ in range(3 * bad):
            w[rng.integers(len(w))] = rng.choice(["wretchkin", "wretchkins", "blorgface", "blorgfaced"])
        rows.append((i, " ".join(w), bad))
    return rows


def test_toxicity_learns_and_generalises_to_misspellings(spark):
    rows = insult_corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, "wretchkinz here"), (9001, ""), (9002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (crc(i, 5) == 0) for i in got)
    y, s = np.array([rows[i][2] for i in held]), np.array([got[i]["score"] for i in held])
    assert auc(y, s) > 0.95
    assert got[9000]["predicted"] == 1 and got[9001]["predicted"] == 0 and got[9002]["score"] == got[9001]["score"] < 0.5


def test_toxicity_without_labels_or_texts(spark):
    odd = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, none).count() == odd.count()
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, one_kind).collect()} == {0}
    assert toxicity.score_toxicity(odd.limit(0), one_kind).count() == 0


def test_long_texts_score_by_their_worst_passage():
    rows = insult_corpus(400, 2)
    model = toxicity.train(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]), 1 << 14)
    calm = " ".join(t for _, t, y in rows[:60] if not y)
    a, b = toxicity.score_texts(model, pa.array([calm, calm + " wretchkin blorgface " + calm]))
    assert b > a
