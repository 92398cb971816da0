import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelight.operators import context, conversation, fusion, metrics, vector
from trovelight.sources.synthetic import random_vectors


def test_fusion_ties(spark):
    lists = [spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(xs)], "qid long, id string, rank int") for xs in (["A", "B"], ["C", "B"])]
    got = fusion.fuse(lists, 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["B", "A", "C"]
    assert got[0]["score"] == pytest.approx(2 / 62)


def test_budget_skips_what_does_not_fit(spark):
    costs = [900, 700, 400, 300, 150, 60]
    rows = spark.createDataFrame([(0, i, i, "x" * (4 * c)) for i, c in enumerate(costs, 1)], "qid long, id long, rank int, text string")
    assert [r["rank"] for r in context.within_budget(rows, 1800).orderBy("rank").collect()] == [1, 2, 5]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 9))
def test_context_order_is_a_permutation(spark, n):
    rows = spark.createDataFrame([(0, i, i) for i in range(1, n + 1)], "qid long, id long, rank int")
    got = [r["id"] for r in context.context_order(rows).orderBy("position").collect()]
    assert sorted(got) == list(range(1, n + 1))
    if n == 6:
        assert got == [1, 3, 5, 6, 4, 2]
    assert got[0] == 1 and got[-1] == min(2, n)


def test_prompt_and_history(spark):
    rows = spark.createDataFrame([(0, "b", 2, "two"), (0, "a", 1, "one")], "qid long, id string, position int, text string")
    assert context.context_prompt(rows).first()["context"] == "[1] (source: a)\none\n\n---\n\n[2] (source: b)\ntwo"
    turns = spark.createDataFrame([(1, i, "user", "x" * 40) for i in range(5)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in conversation.trim_history(turns, 25).orderBy("turn").collect()] == [3, 4]


def test_metrics(spark):
    cases = spark.createDataFrame([(i, ["x"]) for i in range(3)], "qid long, expected array<string>")
    results = spark.createDataFrame([("s", 0, "x", 1), ("s", 1, "x", 3), ("s", 1, "x", 5), ("s", 2, "y", 1)], "strategy string, qid long, source string, rank int")
    row = metrics.summary(metrics.first_relevant(results, cases, ["s", "none"])).filter("strategy = 's'").first()
    assert (row["hit_1"], row["hit_3"], row["mrr"]) == (pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(4 / 9, abs=1e-6))


def test_knn_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    corpus = random_vectors(spark, 60, 8).unionByName(spark.createDataFrame([(100, [1.0]), (101, None)], "id long, vector array<double>"))
    asked = random_vectors(spark, 8, 8, seed=2).select(F.col("id").alias("qid"), "vector")
    got = {(r["qid"], r["rank"]): r["id"] for r in vector.exact_knn(corpus, asked, 5).collect()}
    rows = [(r["id"], r["vector"]) for r in random_vectors(spark, 60, 8).collect()]
    for q in asked.collect():
        best = sorted(((-round(sum(a * b for a, b in zip(v, q["vector"], strict=True)), 6), i) for i, v in rows))[:5]
        assert [got[q["qid"], n] for n in range(1, 6)] == [i for _, i in best]


def test_inverted_file_recall_grows_with_effort(spark):
    corpus = random_vectors(spark, 600, 16, centres=8)
    asked = random_vectors(spark, 10, 16, seed=5).select(F.col("id").alias("qid"), "vector")
    index, exact = vector.InvertedFile.build(corpus, 8), vector.exact_knn(corpus, asked, 10)
    got = [vector.recall(index.search(asked, 10, p), exact, 10).first()["recall"] for p in (1, 4, 8)]
    assert got == sorted(got) and got[-1] == 1.0


def test_nearest_without_or_with_odd_queries(spark):
    from trovelight.operators.vector import InvertedFile, exact_knn

    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [])], "id long, vector array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.5]), ("b", None), ("c", []), ("d", [2.0, 0.0, 0.0])], "qid string, vector array<double>")
    got = sorted(tuple(r) for r in exact_knn(corpus, asked, 2).select("qid", "id", "score", "rank").collect())
    assert got == [("a", 1, 1.0, 1), ("a", 4, 1.0, 2), ("d", 5, 2.0, 1)]
    none = exact_knn(corpus, asked.limit(0), 2)
    assert none.count() == 0 and none.schema["qid"].dataType.simpleString() == "string"
    assert exact_knn(corpus.limit(0), asked, 2).count() == 0
    index = InvertedFile.build(corpus.limit(0), 4)
    assert index.search(asked, 2, 1).count() == 0


def test_best_of_batch_equals_sorting():
    import numpy as np

    from trovelight.operators.vector import best_of_batch

    rng = np.random.default_rng(2)
    for n in (1, 3, 50):
        scores, ids = rng.integers(0, 4, (7, n)) / 2, rng.permutation(n)
        row, col = best_of_batch(scores, ids, 5)
        want = [(q, i) for q in range(7) for i in sorted(range(n), key=lambda i: (-scores[q, i], ids[i]))[:5]]
        assert list(zip(row.tolist(), col.tolist(), strict=True)) == want
