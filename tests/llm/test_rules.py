"""URL filters, quality rules, mixing and decontamination."""

import numpy as np
import pytest
from fixtures import odd_documents
from pyspark.sql import functions as F

from compare import assert_same
from trovelight.llm import decontaminate, registry, urls
from trovelight.llm.mixing import mix_sources, share_out
from trovelight.llm.quality import quality_rules


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_urls(spark):
    rows = ["http://EXAMPLE.org/en/12?x", "https://a.example.org/es/1", "http://example.org", "http://notexample.org/es/", "http://x.com/FR/1", "http://x.com/fr/1#y", None, "no-scheme.org/en/1", "", "http://m.casino-win.net/", "http://casino.net/a", "ftp://user@h.de.com/de/", "http://[::1]/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(pages, [*registry.HOST_RULES, *urls.PATTERNS]).collect()}
    assert got[0] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "", None, "allow")
    assert got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4][2:] == (None, "allow") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == got[8] == ("", "", None, "allow") and got[7][:2] == ("", "")
    assert got[9][3] == "block" and got[10][3] == "block" and got[11][2:] == ("com/de/", "block")
    assert urls.url_filter(pages.limit(0), registry.HOST_RULES).count() == 0
    assert {r["verdict"] for r in urls.url_filter(pages, []).collect()} == {"allow"}


def test_url_rules_in_blocks_and_without_literals(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 2)
    pages = spark.createDataFrame([(1, "http://a1.net/x"), (2, "http://b.net/y")], "page_id long, url string")
    rules = [urls.Rule(f"r{i}", "block", rf"/{c}$", (c,)) for i, c in enumerate("xyzw")] + [urls.Rule("digits", "block", r"\d", ())]
    got = {r["page_id"]: r["pattern_rule"] for r in urls.url_filter(pages, rules).collect()}
    assert got == {1: "digits", 2: "r1"}


def test_quality_of_odd_texts(spark):
    odd = odd_documents(spark)
    got = quality_rules(odd).collect()
    assert len(got) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (4, 5, 6, 7, 17))
    assert next(r for r in got if r["doc_id"] == 17)["n_symbols"] == 8
    assert next(r for r in got if r["doc_id"] == 14)["word_chars"] == 600
    assert quality_rules(odd.limit(0)).count() == 0


def test_quality_fences_adapt_to_the_source(spark):
    plain = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}###" for i in range(80))
    rows = [(i, plain, "en", "books") for i in range(300)] + [(1000 + i, marked, "en", "tables") for i in range(300)] + [(5000, marked, "en", "books")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    assert got[0] and got[1000] and not got[5000]


def test_share_out_gives_shortages_to_siblings(spark):
    rows = spark.createDataFrame([("p", "a", 100, 10, 1), ("p", "b", 100, 1000, 1), ("p", "c", 100, 1000, 2), ("p", "z", 100, 50, 0), ("q", "a", 100, 20, 1), ("q", "b", 100, 30, 5)], "parent string, child string, budget long, supply long, weight long")
    got = {(r["parent"], r["child"]): r["share"] for r in share_out(rows, ["parent"], "child").collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("p", "z"): 0, ("q", "a"): 20, ("q", "b"): 30}


def test_mixing_of_odd_texts(spark):
    odd = odd_documents(spark)
    mixed = mix_sources(odd, F.coalesce(F.col("source"), F.lit("none")), target_percent=60, max_epochs=3, seed=2)
    got = mixed.collect()
    assert len(got) == odd.count()
    leaves = {}
    for r in got:
        leaf = leaves.setdefault((r["domain"], r["lang"], r["source"]), [r["leaf_budget"], 0])
        leaf[1] += r["copies"] * r["n_tokens"]
    assert all(used <= budget for budget, used in leaves.values())
    total = sum(r["n_tokens"] for r in got)
    assert sum(b for b, _ in leaves.values()) <= 0.6 * total
    assert mix_sources(odd.limit(0), F.lit("d")).count() == 0
    with pytest.raises(ValueError):
        mix_sources(odd, F.lit("d"), domain_weights={"d": -1})


def tile_brute(test, text, least):
    """Greedy string tiling by trying every pair of places."""
    free_a, free_b, covered = [True] * len(test), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(test)):
            for j in range(len(text)):
                n = 0
                while i + n < len(test) and j + n < len(text) and test[i + n] == text[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        for x in range(best[0]):
            free_a[best[1] + x] = free_b[best[2] + x] = False
        covered += best[0]


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(40):
        test, text = rng.integers(0, 3, rng.integers(1, 25)), rng.integers(0, 3, rng.integers(1, 60))
        at = [(i, j) for i in range(len(test) - 2) for j in range(len(text) - 2) if (test[i : i + 3] == text[j : j + 3]).all()]
        a, b = (np.array([p[x] for p in at], np.int64) for x in (0, 1))
        tiles = decontaminate.tile(test, text, a, b, 3)
        assert sum(n for *_, n in tiles) == tile_brute(test.tolist(), text.tolist(), 3)
        assert all((test[i : i + n] == text[j : j + n]).all() and n >= 3 for i, j, n in tiles)


def test_contamination(spark, monkeypatch):
    passage = [f"p{i}" for i in range(30)]
    turned = passage[15:] + ["and", "then"] + passage[:15]
    rows = [(1, "Start " + " ".join(passage).upper() + "! end"), (2, " ".join(turned)), (3, " ".join(passage[:20])), (4, " ".join(passage[::2])), (5, None), (6, ""), (7, "tiny item"), (None, " ".join(passage)), (8, " ".join(passage)), (8, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, ", ".join(passage)), (2, "Tiny item."), (3, None), (4, ""), (None, "zz yy xx ww vv uu")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    got = sorted((r["doc_id"] or 0, r["item_id"], r["n_tiles"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 2), (7, 2, 1), (8, 1, 1), (8, 1, 1)]
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_contamination_of_the_tables_equals_brute_force(spark, sf_dir):
    import re

    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    got = {(r["doc_id"], r["item_id"]) for r in registry.op5_decontamination(spark, sf_dir).collect()}
    items = [(r["item_id"], " " + " ".join(tokens(r["text"])) + " ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, t in items if t in " " + " ".join(tokens(r["text"])) + " "}
    assert whole and whole <= got


