"""The corpus pipeline against a brute-force version of its stages."""

import random
import re

import duckdb
import pandas as pd
import pyarrow as pa
from fixtures import ids_and_texts, jaccard_components, odd_documents, repeated_windows, sentence
from test_rules import tile_brute

import corpus_pipeline
from trovelight.llm import native_sql
from trovelight.llm.langid import detect_languages


def brute(spark, docs, items):
    """Rows that run() returns. Language predictions are the operator's; test_models judges these."""
    rejected = {r["doc_id"] for r in detect_languages(docs).collect() if r["lang_pred"] == "und" or r["score"] < 0.5}
    rows = [r for r in docs.collect() if r["doc_id"] not in rejected]
    groups = jaccard_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r, (k, _, c) in zip(rows, groups, strict=True) if k == c]
    texts = [(r["text"] or "").encode() for r in rows]
    kept = []
    for r, b, gone in zip(rows, texts, repeated_windows(texts, corpus_pipeline.PASSAGE_BYTES), strict=True):
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            kept.append((r, left))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    tests = [w for w in (words(t or "") for t in items) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    clean = []
    for r, t in kept:
        w = words(t)
        own = grams(w)
        if not any(len(own & grams(x)) and tile_brute(x, w, 5) >= 0.8 * len(x) for x in tests):
            clean.append((r["doc_id"], t, r["lang"], r["source"]))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source"]))
    return con.execute(f"SELECT * FROM ({native_sql.MIX}) WHERE copies > 0 ORDER BY doc_id").fetchall()


def test_run_equals_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == brute(spark, docs, [t for _, t in ids_and_texts(items.withColumnRenamed("item_id", "doc_id"))])


def test_stages_of_odd_documents(spark, sf_dir):
    docs = odd_documents(spark)
    for name in ("cut_text", "cut_id", "pipeline_cut_text", "pipeline_row_key"):
        docs = docs.withColumn(name, docs["n"])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        else:
            assert out.filter("copies < 1").count() == 0
    texts = [t for _, t in ids_and_texts(docs)]
    assert len(texts) == len(set(texts)) > 10 and None not in texts


def texts_without_id(table):
    return sorted(t for k, t in ids_and_texts(table) if k is None)


def test_documents_without_id_are_rejected_as_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    add = lambda texts: docs.unionByName(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), allowMissingColumns=True)
    rng = random.Random(6)
    named, one, other = docs.filter("length(text) > 400").first()["text"], sentence(rng, 100), sentence(rng, 100)
    table = add([named + " more", one, one + " more", other])
    got = corpus_pipeline.near_duplicates(spark, table, sf_dir)
    left = texts_without_id(got)
    assert other in left and len(left) == 2 and named in {r["text"] for r in got.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(5).collect()]
    assert texts_without_id(corpus_pipeline.benchmark_passages(spark, add([*items, one + " " + items[0], other]), sf_dir)) == [other]
    mixed = [" ".join(r["text"].split()[:20]) for r in docs.groupBy("lang").agg({"text": "min"}).withColumnRenamed("min(text)", "text").collect()]
    table = add([*mixed, " ".join(mixed), *(" ".join(w) for w in zip(*(m.split() for m in mixed), strict=False)), "zq", "123"])
    nameless = table.filter("doc_id is null").withColumnRenamed("doc_id", "was").selectExpr("monotonically_increasing_id() as n", "text")
    scored = detect_languages(table.withColumn("n", corpus_pipeline.F.crc32("text")), key_col="n").select("n", "lang_pred", "score").distinct()
    judged = nameless.withColumn("n", corpus_pipeline.F.crc32("text")).join(scored, "n").collect()
    want = sorted(r["text"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.5)
    assert texts_without_id(corpus_pipeline.language_id(spark, table, sf_dir)) == want
    assert any(r["lang_pred"] != "und" and r["score"] < 0.5 for r in judged)


def test_stages_send_workers_small_batches(spark, sf_dir, monkeypatch):
    def rejects_large_batches(docs, key_col):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(key_col), pa.array(["und" if n > 1000 else "en"] * n), pa.array([1.0] * n)], names=[key_col, "lang_pred", "score"])

        return docs.select(key_col).mapInArrow(run, f"{key_col} long, lang_pred string, score double")

    monkeypatch.setattr(corpus_pipeline, "detect_languages", rejects_large_batches)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'s' as source", "9L as n_chars").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert corpus_pipeline.language_id(spark, docs, sf_dir).count() == 3000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
