"""BM25: texts scored where they lie give the rows of the join of postings, and only the best leave a task."""

import random

import pytest
from trovelight.operators import lexical
from trovelight.operators.lexical import LexicalIndex, bm25, term_freq, tokenized, top_k


def texts_of(rng, n):
    return [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.choice((0, 1, 3, 40)))) for _ in range(n)]


def found(index, asked, k):
    return sorted(map(tuple, bm25(index, asked, k).select("qid", "id", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("pairs", [1 << 20, 7])
@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_texts_in_place_equal_joined_postings(spark, monkeypatch, pairs, again, kind):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    rng = random.Random(3)
    rows = list(enumerate(texts_of(rng, 150))) + [(200, None), (201, "")]
    if again:  # ids on several rows, of equal and of other lengths, and rows without id
        rows += [(3, rows[3][1]), (5, "aa bb aa"), (5, "cc aa dd"), (5, "aa"), (None, "aa bb"), (None, "bb cc"), (None, None)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr(f"cast(id as {kind}) id", "text").repartition(3)
    asked = [(f"q{i}", t) for i, t in enumerate(texts_of(rng, 9))] + [("q1", "aa"), (None, "bb cc"), ("none", "zz")]
    asked = spark.createDataFrame(asked, "qid string, text string")
    tokens = tokenized(docs, "id", "text")
    plain = LexicalIndex(term_freq(tokens), lexical.doc_freq(term_freq(tokens)), lexical.corpus_stats(tokens))
    index = LexicalIndex.for_queries(docs, "id", "text", asked)
    assert index.stats.first() == plain.stats.first()
    wanted = lexical.query_terms(asked).select("term")
    for name in ("postings", "frequencies"):
        got, want = getattr(index, name), getattr(plain, name).join(wanted, "term", "left_semi")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert found(index, asked, 4) == found(plain, asked, 4)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)  # more terms than that are counted and joined by shuffles
    assert found(LexicalIndex.for_queries(docs, "id", "text", asked), asked, 4) == found(plain, asked, 4)


def test_only_the_best_leave_a_task(spark):
    docs = spark.range(0, 6000, 1, 3).selectExpr("id", "concat('aa ', repeat('bb ', int(id % 50))) text")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "qid long, text string")
    scored = []
    keep = lexical.top_k
    lexical.top_k = lambda rows, *a, **b: scored.append(rows.count()) or keep(rows, *a, **b)
    try:
        rows = bm25(LexicalIndex.for_queries(docs, "id", "text", asked), asked, 5)
    finally:
        lexical.top_k = keep
    assert rows.count() == 10
    assert scored[0] <= 2 * 5 * 8  # the join of postings gave 12,000


def test_no_queries_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "aa bb")], "id long, text string")
    asked = spark.createDataFrame([(1, "aa")], "qid long, text string")
    assert found(LexicalIndex.for_queries(docs, "id", "text", asked.limit(0)), asked.limit(0), 3) == []
    assert found(LexicalIndex.for_queries(docs.limit(0), "id", "text", asked), asked, 3) == []
    assert top_k(bm25(LexicalIndex.for_queries(docs, "id", "text", asked), asked, 3).drop("rank"), 1).count() == 1
