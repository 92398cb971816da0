"""Registered queries of the library's own operators over the given tables."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelight.functions import models, text
from trovelight.functions.calls import Resource
from trovelight.operators import chunking, context, conversation, fusion, graph, lexical, metrics, vector
from trovelight.plans import engine, evaluate, registry_sql
from trovelight.plans.retriever import VARIANTS, Retriever, rerank
from trovelight.sources import csv_splits as csv_reader
from trovelight.sources import files, index, scratch
from trovelight.sources.tables import read_texts
from trovelight.streaming import histories, replies, state

K, CANDIDATES = 10, 20
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_texts(spark, f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is a question."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search queries: every vector whose id is divisible by 50."""
    return _vectors(spark, sf_dir).filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "vector")


def _question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the vector of the same number."""
    return _questions(spark, sf_dir).join(_vectors(spark, sf_dir), F.col("qid") == F.col("id")).select("qid", "vector")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = _questions(spark, sf_dir)
    return lexical.bm25(lexical.LexicalIndex.for_queries(_texts(spark, sf_dir, "documents"), "doc_id", "text", asked), asked, k)


def _hybrid(spark: SparkSession, sf_dir: str, k: int, keyword: DataFrame | None = None) -> DataFrame:
    """keyword: the list of _bm25 with CANDIDATES rows a question, if it is there already."""
    near = vector.exact_knn(_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), CANDIDATES)
    return fusion.fuse([near, keyword if keyword is not None else _bm25(spark, sf_dir, CANDIDATES)], k)


def _with_text(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return found.join(docs, "id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_batch(spark, sf_dir)


@query
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_texts(spark, sf_dir, "documents"), source_col="doc_id")


@query
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(html_to_text(spark, sf_dir), source_col="page_id")


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.tokenized(_texts(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_freq(lexical.tokenized(_texts(spark, sf_dir, "documents"), "doc_id", "text"))


@query
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_freq(term_freq(spark, sf_dir))


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(lexical.tokenized(_texts(spark, sf_dir, "documents"), "doc_id", "text")).withColumn("avgdl", F.round("avgdl", 6))


@query
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query
def loader_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", files.loader_of(F.regexp_extract("url", r"://([^?#]*)", 1)).alias("loader"))


@query
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, CANDIDATES)


@query
def vector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.exact_knn(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), K)


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).withColumn("unit", text.normalize(F.col("vector")))
    first = F.round(F.element_at("unit", 1), 6)
    return unit.select("id", F.round(text.dot(F.col("unit"), F.col("unit")), 6).alias("length"), first.alias("first"))


@query
def vector_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.InvertedFile.build(_vectors(spark, sf_dir), 16).search(_asked_vectors(spark, sf_dir), K, 14)


@query
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.recall(vector_inverted_file(spark, sf_dir), vector_batch(spark, sf_dir), K)


@query
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, CANDIDATES)


@query
def rrf_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuses the question's keyword list with those of its first and last line."""
    asked = _questions(spark, sf_dir)
    lines = F.split("text", "\n")
    forms = [asked, asked.withColumn("text", F.element_at(lines, 1)), asked.withColumn("text", F.element_at(lines, -1))]
    index = lexical.LexicalIndex.for_queries(_texts(spark, sf_dir, "documents"), "doc_id", "text", asked)
    return fusion.fuse([lexical.bm25(index, q, CANDIDATES) for q in forms], K)


@query
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_text(spark, sf_dir, _hybrid(spark, sf_dir, CANDIDATES))
    return rerank(found.join(_questions(spark, sf_dir).withColumnRenamed("text", "question"), "qid"), 6)


@query
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.within_budget(_with_text(spark, sf_dir, _hybrid(spark, sf_dir, CANDIDATES)))


@query
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_order(budget_select(spark, sf_dir)).select("qid", "id", "rank", "position")


@query
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = context.context_prompt(_with_text(spark, sf_dir, context_order(spark, sf_dir)))
    return prompts.select("qid", F.md5("context").alias("context_md5"), F.array_join("ids", ",").alias("ids"))


@query
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.search_report(_with_text(spark, sf_dir, bm25_batch(spark, sf_dir)))


@query
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.sources_report(_with_text(spark, sf_dir, bm25_batch(spark, sf_dir)))


@query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message, with marks made from its turn, cites among five names."""
    turns = _table(spark, sf_dir, "conversations")
    marks = F.concat("text", F.format_string(" [%d]. [%d][1] [%d] [1, 3]", F.col("turn") + 2, F.col("turn") % 3, F.col("conv_id") % 9))
    answers = turns.select(F.concat_ws("-", "conv_id", "turn").alias("qid"), marks.alias("answer"), F.array(*(F.concat(F.lit(f"c{i}-"), "conv_id") for i in range(1, 6))).alias("ids"))
    return engine.cited_sources(answers)


@query
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.trim_history(_table(spark, sf_dir, "conversations"), 150).select("conv_id", "turn", "role")


@query
def history_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.transcript(_table(spark, sf_dir, "conversations").filter("role <> 'system'"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose passage some document holds, with these documents. A passage's third to fifth word stand whole
    in every text that holds it, so documents that hold these three in a row are found first, without their texts, and then
    the texts of such pairs are compared."""
    words = F.split("text", r"\s+")
    asked = _questions(spark, sf_dir).filter(F.size(words) > 5)
    docs = _texts(spark, sf_dir, "documents").select("doc_id", "text")
    found = lexical.holders(docs.select("doc_id", words.alias("words")), asked.select("qid", F.slice(words, 3, 3).alias("words")), "doc_id", "qid")
    pairs = scratch.Scratch(spark).kept(found.select("qid", F.col("doc_id").alias("held_by")).distinct(), "pairs")
    few = pairs.limit(lexical.BROADCAST_TERMS + 1).count() <= lexical.BROADCAST_TERMS
    bodies = docs.select("doc_id", F.col("text").alias("body")).join(F.broadcast(pairs) if few else pairs, F.col("doc_id").eqNullSafe(F.col("held_by")))
    held = bodies.join(asked, "qid").filter(F.contains("body", "text")).select("qid", "text", "doc_id").distinct()
    return held.groupBy("qid", "text").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both strategies from one keyword list, whose first six are those of bm25 alone."""
    kept = scratch.Scratch(spark).kept
    keyword = kept(_bm25(spark, sf_dir, CANDIDATES), "keyword")
    runs = {"bm25": keyword.filter("rank <= 6"), "hybrid": _hybrid(spark, sf_dir, 6, keyword)}
    out = None
    for name, found in runs.items():
        rows = found.select(F.lit(name).alias("strategy"), "qid", F.col("id").cast("string").alias("source"), "rank")
        out = rows if out is None else out.unionByName(rows)
    return metrics.first_relevant(out, kept(_cases(spark, sf_dir), "cases"), list(runs))


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_runs(spark, sf_dir))


@query
def eval_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).filter("first_rank is null").select("strategy", "qid")


@query
def variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.variant_lines(F.col("text"), 3), "|").alias("variants"))


@query
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.embed(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "vector")


@query
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer written as a CSV file of one record, and read back as a document."""
    row = F.concat(F.lit('name,segment,nation\r\n"'), F.col("c_name"), F.lit(', ""x"""," '), F.col("c_mktsegment"), F.lit('",'), F.col("c_nationkey").cast("string"), F.lit("\r\n\r\n"))
    made = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("csv").alias("loader"), F.encode(row, "UTF-8").alias("content"))
    return files.documents_of(made).select("source", "text")


@query
def csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers written as CSV files, with quotes and newlines in a field, and read back in splits."""
    remark = F.concat(F.lit('seen, "'), F.col("c_name"), F.lit('"\n'), F.col("c_mktsegment"))
    made = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), remark.alias("remark"), F.col("c_nationkey").alias("nation"))
    path = f"{scratch.shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    made.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return csv_reader.csv_documents_of(spark, path).select("text")


@query
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation's trimmed history starts with."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return history_trim(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def _embedded(spark: SparkSession, sf_dir: str, questions: DataFrame, model: object = None) -> Retriever:
    """Retrieval over documents as chunks, embedded once, with the keyword index of the questions' terms."""
    docs = _texts(spark, sf_dir, "documents")
    chunks = models.embed(docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source"), "text"))
    terms = lexical.LexicalIndex.for_queries(docs, "doc_id", "text", questions)
    return Retriever(scratch.Scratch(spark).kept(chunks, "chunks"), terms, model=model)


@query
def vector_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents of each question, both embedded."""
    asked = _questions(spark, sf_dir)
    return _embedded(spark, sf_dir, asked).vector(asked, CANDIDATES)


@query
def hybrid_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector lists of the same questions over the same documents, fused."""
    asked = _questions(spark, sf_dir)
    return _embedded(spark, sf_dir, asked).hybrid(asked, CANDIDATES)


class _WordsOfTheQuestion:
    """Stands for a language model: rephrases a question by its first and its last two words, and answers with the last."""

    def available(self) -> bool:
        return True

    def complete(self, system: str, messages: list[dict[str, str]]) -> str:
        words = messages[-1]["content"].split(": ", 1)[1].split(" ")
        first, last = " ".join(words[:2]), " ".join(words[-2:])
        return f"{first}\n{last}" if system == VARIANTS else last


def _strategies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Short questions, three words of a passage, whose documents are those that hold the whole passage."""
    anchor = F.array_join(F.slice(F.split("text", r"\s+"), 3, 3), " ")
    cases = scratch.Scratch(spark).kept(_cases(spark, sf_dir).select("qid", anchor.alias("text"), "expected"), "cases")
    return evaluate.evaluate(_embedded(spark, sf_dir, cases.select("qid", "text"), Resource(_WordsOfTheQuestion)), cases)


@query
def eval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six strategies judged over the same questions in one run."""
    return _strategies(spark, sf_dir)[0]


@query
def eval_strategy_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategies(spark, sf_dir)[1].select("text", F.array_join(F.array_sort("expected"), ",").alias("expected"))


@query
def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.NeighbourGraph.build(_vectors(spark, sf_dir)).search(_asked_vectors(spark, sf_dir), K, 50)


@query
def vector_graph_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and vectors visited of the graph at five efforts, beside exact search."""
    return evaluate.graph_curve(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), K)


@query
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search of bm25_batch over an index on disk to which the documents came in three batches."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("documents").alias("source"), F.lit(0).alias("chunk_index"), "text", F.array().cast("array<float>").alias("vector"))
    path = f"{scratch.shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    for n in range(3):
        index.put_batch(docs.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == n), path, n)
    _, lexical_index = index.load(spark, path)
    # ties go by number, as in bm25_batch
    numbered = dataclasses.replace(lexical_index, postings=lexical_index.postings.withColumn("id", F.col("id").cast("long")))
    return lexical.bm25(numbered, _questions(spark, sf_dir), CANDIDATES)


@query
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history_trim, kept as state while the conversations come in as a stream."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    folder = f"{scratch.shared_folder(spark)}/histories-{uuid.uuid4().hex}"
    updates = histories.run_histories(_as_stream(turns, f"{folder}/in", 4), f"{folder}/out", f"{folder}/checkpoint", 150)
    return histories.latest(updates).select("conv_id", "turn", "role")


def _as_stream(rows: DataFrame, folder: str, batches: int) -> DataFrame:
    """The rows as a stream that takes `batches` micro-batches."""
    rows.repartition(batches).write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as NDJSON of its sentences; those of odd turns break off before the last newline."""
    sentence = lambda x: F.to_json(F.struct(F.struct(F.concat(x, F.lit(". ")).alias("content")).alias("message")))
    lines = F.array_join(F.transform(F.split("text", r"\. "), sentence), "\n")
    ended = F.when(F.col("turn") % 2 == 0, "\n").otherwise("")
    return _table(spark, sf_dir, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("reply"), F.concat(lines, ended).alias("ndjson"))


@query
def reply_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("reply", models.stream_content(F.col("ndjson")).alias("content")).filter("content <> ''")


@query
def reply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reply_contents from a stream of pieces of 300 bytes, which cut lines and letters."""
    data = _replies(spark, sf_dir).select("reply", F.encode("ndjson", "UTF-8").alias("data"))
    every = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / 300).cast("int"))
    pieces = data.select("reply", "data", F.explode(every).alias("seq")).select("reply", F.col("seq").cast("long").alias("seq"), F.substring("data", F.col("seq") * 300 + 1, F.lit(300)).alias("piece"))
    folder = f"{scratch.shared_folder(spark)}/replies-{uuid.uuid4().hex}"
    lines = state.run_available(replies.reply_lines(_as_stream(pieces, f"{folder}/in", 3)), f"{folder}/out", f"{folder}/checkpoint")
    return replies.contents(lines)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in registry_sql.SQL.items() if k in _queries}
