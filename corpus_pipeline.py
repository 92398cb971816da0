"""A corpus pipeline over `documents`: language ID, near duplicates, repeated passages, benchmark passages, mixing.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns how
many copies of each document the mixture takes. Decisions are made by doc_id: where an id is repeated, a rejection
holds for all its rows. Rows without an id are told apart by a hash of their text (`row_key`) and rejected as others are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm.decontaminate import contamination
from trovelight.llm.langid import detect_languages
from trovelight.llm.mixing import mix_sources
from trovelight.llm.ngram_join import ngram_join
from trovelight.llm.registry import MIX, domain_of
from trovelight.llm.shared import likely_in, settled, small_batches, written
from trovelight.llm.suffix import suffix_dedup


KEY = "pipeline_row_key"
#: Shortest passage that `repeated_passages` takes out, in bytes: about forty words.
PASSAGE_BYTES = 240


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key that is never null: the id, or else a hash of the text, from 2**62 on, so that in a group of
    near copies an id below that goes before it. Returns only id, text, language and key, whatever else there is."""
    return docs.select("doc_id", "text", "lang", row_key(docs).alias(KEY))


def row_key(docs: DataFrame) -> Column:
    """What `keyed` names a row by."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(docs["text"]), 2))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents but for those whose key is rejected. Only rows that a bounded bitmap of rejected keys does not clear are
    shuffled, to be joined with the keys themselves."""
    gone = written(rejected.select(KEY).distinct(), "rejected")
    key = row_key(docs)
    doubtful = likely_in(docs, key, gone)
    left = doubtful.join(gone, key == gone[KEY], "left_anti")
    return likely_in(docs, key, gone, others=True).unionByName(left)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until documents have no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage with small record batches: whatever it runs in Python workers, it runs before it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


@lean
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (`und`), null and empty texts among them, and those whose language is less likely
    than not."""
    rejected = detect_languages(keyed(docs), key_col=KEY).filter((F.col("lang_pred") == "und") | (F.col("score") < 0.5))
    # a text without letters goes by itself, whatever its id
    return without(docs.filter(F.col("text").rlike(r"\p{L}")), rejected)


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest key of each group of five-word shingle similarity 0.8 or more. Documents
    without words are in no group. Equal rows of one id are copies of each other, and one stays."""
    groups = settled(lambda: ngram_join(keyed(docs), id_col=KEY, words=5, num=80, den=100), "groups")
    kept = without(docs, groups.filter(f"component_id <> {KEY}"))
    if not groups.filter(f"n_shingles > 0 and component_id = {KEY}").groupBy(KEY).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


@lean
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every passage of PASSAGE_BYTES that also starts elsewhere; documents of which nothing is left go.
    Null and empty texts hold no passage and stay. n_chars follows the text; a null id is as good as any."""
    cut = settled(lambda: suffix_dedup(docs, length=PASSAGE_BYTES, with_bytes=False).filter("n_removed > 0").select("doc_id", "text_sha256", "kept_text"), "cut")
    if not cut.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():  # equal rows, cut alike
        cut = cut.dropDuplicates(["doc_id", "text_sha256"])
    names = [free_name(docs, f"pipeline_cut_{x}") for x in ("id", "sha", "text")]
    cut_ids = written(cut.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text_sha256"))).toDF("id").distinct(), "cut_ids")
    cut = cut.toDF(*names)
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    key = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(sha))
    left = F.col(names[2])
    same = docs["doc_id"].eqNullSafe(F.col(names[0])) & (sha == F.col(names[1]))
    # rows that no cut text can belong to are not shuffled
    out = likely_in(docs, key, cut_ids).join(cut, same, "left").filter(left.isNull() | (left != ""))
    rest = likely_in(docs, key, cut_ids, others=True)
    changed = {"text": F.coalesce(left, F.col("text")), "n_chars": F.when(left.isNull(), F.col("n_chars")).otherwise(F.length(left).cast("long"))}
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns)).unionByName(rest)


@lean
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold four fifths or more of a benchmark item's words, in tiles of five words or more. Null
    and empty texts, and items without words, match nothing. A rejection holds for all rows of an id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, contamination(keyed(docs), items, id_col=KEY, min_tile=5, threshold=0.8))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with their copies. Null languages and sources are leaves of their own named
    ''; texts without words are never taken; repeated rows are taken each by itself."""
    return mix_sources(docs, domain_of(), **MIX).filter("copies > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: Similarity groups, byte passages and tiles have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
