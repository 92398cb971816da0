"""Ingest, search, ask and chat over an index folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.functions.models import Embedder, LanguageModel, PairScorer, embed, hashed_embedder
from trovelight.functions.text import citations
from trovelight.operators.chunking import chunk_documents
from trovelight.operators.context import context_order, context_prompt, within_budget
from trovelight.operators.lexical import LexicalIndex
from trovelight.plans.retriever import CANDIDATES, Retriever
from trovelight.sources import index as stored
from trovelight.sources.files import discover, load_files
from trovelight.sources.stored_files import load_stored

CHUNK_BUDGET, HISTORY_BUDGET = 1800, 800
ANSWER = "Answer in a few sentences from the numbered documents alone, and put the number of the supporting document in brackets after each claim, like [2]. Say so if they do not hold the answer."
CONDENSE = "Rewrite the follow-up as a question that stands alone, using the conversation. Only the question."


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder = hashed_embedder, scorer: PairScorer | None = None, model: LanguageModel | None = None):
        self.spark, self.path, self.embedder, self.scorer, self.model = spark, path, embedder, scorer, model

    def ingest(self, target: str) -> tuple[int, DataFrame]:
        """Reads, chunks, embeds and writes all files below `target`, a local path or the address of any store that Spark
        reads. Returns the number of chunks and the files that could not be read, as (source, error)."""
        if "://" in target:
            docs = load_stored(self.spark, target)
        else:
            files = discover(target)
            if not files:
                raise FileNotFoundError(f"no loadable files under {target}")
            docs = load_files(self.spark, files)
        chunks = embed(chunk_documents(docs.filter("error is null")), "text", self.embedder)
        written = stored.save(chunks, self.path)
        return sum(s.rows for s in written.segments), docs.filter("error is not null").select("source", "error")

    def retriever(self) -> Retriever:
        chunks, lexical = stored.load(self.spark, self.path)
        return retriever_of(chunks, lexical, self.embedder, self.scorer, self.model)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """questions: (qid, text). The hybrid list of each, cut to the token budget, with texts and sources."""
        r = self.retriever()
        found = r.hybrid(questions, CANDIDATES).join(r.chunks.select("id", "source", "text"), "id")
        return within_budget(found).select("qid", "id").join(found, ["qid", "id"])

    def search(self, question: str) -> DataFrame:
        return search_report(self.retrieve(self._one(question)))

    def _one(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([(0, question)], "qid long, text string")

    def ask(self, question: str, history: list[dict[str, str]] | None = None) -> dict[str, object]:
        """Answer, cited chunk ids, and all chunks shown."""
        if self.model is None:
            raise RuntimeError("asking needs a language model")
        ordered = context_order(self.retrieve(self._one(question)).select("qid", "id", "rank", "text"))
        row = context_prompt(ordered).first()
        context, ids = (row["context"], row["ids"]) if row else ("", [])
        answer = self.model.complete(ANSWER, [*(history or []), {"role": "user", "content": f"Documents:\n\n{context}\n\nQuestion: {question}"}])
        said = self.spark.createDataFrame([(answer,)], "answer string")
        cited = said.select(citations(F.col("answer"), F.lit(len(ids)))).first()[0]
        return {"answer": answer, "cited": [(n, ids[n - 1]) for n in cited], "shown": ids}

    def chat(self, lines: Iterable[str]) -> Iterator[dict[str, object]]:
        """Answers question after question; a follow-up is first made to stand alone. Blank lines are passed over,
        `exit` and `quit` end."""
        history: list[dict[str, str]] = []
        for line in lines:
            question = line.strip()
            if question in ("exit", "quit"):
                return
            if not question:
                continue
            alone = condense(self.model, history, question)
            said = self.ask(alone, history)
            history += [{"role": "user", "content": question}, {"role": "assistant", "content": str(said["answer"])}]
            while history and sum(-(-len(m["content"]) // 4) for m in history) > HISTORY_BUDGET:
                history.pop(0)
            yield said | {"question": alone}


def retriever_of(chunks: DataFrame, lexical: LexicalIndex | None, embedder: Embedder = hashed_embedder, scorer: PairScorer | None = None, model: LanguageModel | None = None) -> Retriever:
    """`ord` is a 63-bit hash of the chunk id: it names vectors by number and breaks their ties the same way always."""
    rows = chunks.select(F.expr("xxhash64(chunk_id) & 9223372036854775807").alias("ord"), F.col("chunk_id").alias("id"), "source", "text", "vector")
    return Retriever(rows, lexical or LexicalIndex.build(rows, "id", "text"), embedder, scorer, model)


def condense(model: LanguageModel | None, history: list[dict[str, str]], question: str) -> str:
    if not history or model is None:
        return question
    said = "\n".join(f"{'User' if m['role'] == 'user' else 'Assistant'}: {m['content']}" for m in history)
    return model.complete(CONDENSE, [{"role": "user", "content": f"{said}\n\nFollow-up: {question}"}]).strip() or question


def search_report(found: DataFrame) -> DataFrame:
    """(qid, id, rank, score, text) as lines: score and id, and the first 300 characters on one line."""
    return found.select("qid", "rank", F.format_string("[%.4f] %s", F.floor(F.col("score") * 10000 + 0.5) / 10000, F.col("id").cast("string")).alias("head"), F.concat(F.regexp_replace(F.substring("text", 1, 300), r"\s+", " "), F.lit("…")).alias("body"))


def sources_report(found: DataFrame) -> DataFrame:
    """Number of results and their distinct sources in order of rank."""
    rows = found.groupBy("qid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("x"))
    return rows.select("qid", "n", F.array_join(F.array_distinct(F.col("x.source")), ", ").alias("sources"))


def cited_sources(answers: DataFrame) -> DataFrame:
    """answers: (qid, answer, ids). One row per cited number, rising."""
    marks = citations(F.col("answer"), F.size("ids"))
    return answers.select("qid", "ids", F.explode(marks).alias("n")).select("qid", "n", F.element_at("ids", F.col("n").cast("int")).alias("id"))
