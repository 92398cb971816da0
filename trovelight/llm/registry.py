"""The numbered queries over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import native_sql, new_sql, quality_sql
from trovelight.llm.decontaminate import contamination
from trovelight.llm.katz import katz_scores
from trovelight.llm.langid import detect_languages
from trovelight.llm.mixing import mix_sources
from trovelight.llm.pii import find_pii, pii_digest
from trovelight.llm.quality import quality_rules
from trovelight.llm.resampling import importance_resample
from trovelight.llm.substring import substring_dedup
from trovelight.llm.ngram_join import ngram_join
from trovelight.llm.suffix import suffix_dedup
from trovelight.llm.toxicity import score_toxicity
from trovelight.llm.urls import PATTERNS, host_rule, url_filter
from trovelight.llm.vector_codes import vector_codes

#: Rules of op4, beside the method's own patterns.
HOST_RULES = (host_rule("allow", "org/"), host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"), host_rule("allow", "com/fr/"), host_rule("block", "com/de/"))
#: Shortest passage whose bytes op7 counts beside what it removes: about forty words.
PASSAGE_BYTES = 240
#: Weights of op8 and of the pipeline's last stage.
MIX = {"target_percent": 50, "domain_weights": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang_weights": {"en": 5, "fr": 2, "de": 2, "es": 1}, "max_epochs": 2, "seed": 17}


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, [*HOST_RULES, *PATTERNS]).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, length=400, with_bytes=False, with_text=False, also=PASSAGE_BYTES).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def domain_of(source: str = "source") -> Column:
    """Four domains, by the number at the end of a source's name."""
    return F.concat(F.lit("d"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) as bigint)"), F.lit(0)) % 4)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), domain_of(), **MIX)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, window=35, with_text=False).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_lm_scores, op4_url_filters, op5_decontamination, op6_toxicity, op7_suffix_dedup, op8_mix_sources, op9_substring_dedup, op10_quality_rules, op11_pii, op12_vector_codes, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": native_sql.URLS, "op8_mix_sources": native_sql.MIX, "op10_quality_rules": quality_sql.SQL, "op11_pii": new_sql.PII, "op12_vector_codes": new_sql.CODES}
