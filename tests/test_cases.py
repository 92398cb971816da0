"""Evaluation cases: documents that hold a passage, and lists that both strategies share."""

import pytest
from trovelight.operators import lexical
from trovelight.plans import registry

LONG = "one two three four five six seven"


def tables(spark, folder, docs, passages):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("few", [True, False])
def test_cases_equal_a_search_of_every_text(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", 1)
    docs = [(1, f"x {LONG} y"), (2, f"x{LONG}y"), (3, LONG.replace(" ", "  ")), (4, None), (5, ""), (5, f"b {LONG}"), (6, "three four five " * 3), (7, "three four"), (8, f"{LONG}\n{LONG}"), (None, LONG), (9, "two lines\nof a text that ends"), (1, "other")]
    passages = [(1, LONG), (2, LONG), (3, "lines\nof a text that ends"), (4, "three four five"), (5, None), (6, "a b c three four five g"), (7, "")]
    got = registry._cases(spark, tables(spark, tmp_path, docs, passages)).collect()
    want = {}
    for qid, passage in passages:
        if passage and len(passage.split()) > 5:
            held = [d for d, t in docs if t and passage in t]
            if held:
                want[qid] = sorted({str(d) for d in held if d is not None})
    assert {r.qid: sorted(r.expected) for r in got} == want == {1: ["1", "2", "5", "8"], 2: ["1", "2", "5", "8"], 3: ["9"]}


def test_no_row_of_a_text_for_each_of_its_words(spark, tmp_path):
    """A text of n words was repeated n times before the join, 240 MB for this one."""
    path = tables(spark, tmp_path, [(1, "word " * 7000 + LONG)], [(1, LONG)])
    found = registry._cases(spark, path)
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r.expected) for r in found.collect()] == [("1",)]


def test_both_strategies_share_one_keyword_list(spark, sf_dir, monkeypatch):
    made, make = [], lexical.LexicalIndex.for_queries.__func__
    monkeypatch.setattr(lexical.LexicalIndex, "for_queries", classmethod(lambda cls, *a: made.append(a) or make(cls, *a)))
    assert registry.eval_metrics(spark, sf_dir).count() == 2
    assert len(made) == 1
