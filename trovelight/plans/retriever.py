"""Retrieval strategies over an index, each for a whole batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.functions.calls import Policy, Resource, as_resource, ask_all
from trovelight.functions.models import Embedder, LanguageModel, PairScorer, embed, hashed_embedder, pair_score
from trovelight.functions.text import variant_lines
from trovelight.operators.fusion import fuse, fuse_numbered
from trovelight.operators.lexical import BROADCAST_TERMS, LexicalIndex, bm25, top_k
from trovelight.operators.vector import exact_knn
from trovelight.sources.scratch import Scratch

CANDIDATES = 20
HYDE = "Write a short passage, as a manual might have it, that answers the question. Only the passage."
VARIANTS = "Rephrase the search query. One rephrasing a line and nothing else."


def rerank(candidates: DataFrame, k: int, scorer: PairScorer | None = None) -> DataFrame:
    """candidates: (qid, id, rank, question, text). Scores each pair jointly; the k best, ties by the rank before."""
    scored = candidates.withColumn("score", F.round(pair_score(F.col("question"), F.col("text"), scorer), 6)).withColumnRenamed("rank", "before")
    return top_k(scored, k, order=(F.desc("score"), F.col("before"))).select("qid", "id", "score", "rank")


@dataclass
class Retriever:
    """chunks: (id, source, text, vector); `ord` stands for insertion order, as ids do in ties."""

    chunks: DataFrame
    lexical: LexicalIndex
    embedder: Embedder = hashed_embedder
    scorer: PairScorer | None = None
    model: LanguageModel | Resource | None = None
    policy: Policy = field(default_factory=Policy)
    #: (qid, error, tries) of the model calls that failed, a table for each strategy that has run.
    failures: list[DataFrame] = field(init=False, default_factory=list)
    strategies: dict[str, Callable[[DataFrame, int], DataFrame]] = field(init=False)
    #: The questions of `remember`, and their lists by strategy.
    _asked: DataFrame | None = field(init=False, default=None)
    _lists: dict[str, DataFrame] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.strategies = {"vector": self.vector, "bm25": self.bm25, "hybrid": self.hybrid, "rerank": self.hybrid_reranked}
        if self.model is not None and as_resource(self.model).get().available():
            self.strategies |= {"hyde": self.hyde, "multi_query": self.multi_query}

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.chunks.select("ord", "id"), "ord").select("qid", "id", "score", "rank")

    def remember(self, questions: DataFrame) -> None:
        """Makes the vector and the keyword list of these questions once, as written tables. Strategies that are then asked
        with this very DataFrame begin with them instead of searching anew."""
        kept = Scratch(questions.sparkSession).kept
        self._asked = None
        self._lists = {name: kept(search(questions, CANDIDATES), name) for name, search in (("vector", self.vector), ("bm25", self.bm25))}
        self._asked = questions

    def _remembered(self, name: str, questions: DataFrame, k: int) -> DataFrame | None:
        return self._lists[name].filter(F.col("rank") <= k) if questions is self._asked and k <= CANDIDATES else None

    def vector(self, questions: DataFrame, k: int) -> DataFrame:
        """questions: (qid, text). Exact nearest chunks of the embedded questions."""
        if (known := self._remembered("vector", questions, k)) is not None:
            return known
        return self._nearest(embed(questions, "text", self.embedder), k)

    def _nearest(self, queries: DataFrame, k: int) -> DataFrame:
        found = exact_knn(self.chunks, queries.select("qid", "vector"), k, id_col="ord")
        return self._named(found.withColumnRenamed("id", "ord"))

    def bm25(self, questions: DataFrame, k: int) -> DataFrame:
        if (known := self._remembered("bm25", questions, k)) is not None:
            return known
        return bm25(self.lexical, questions, k)

    def hybrid(self, questions: DataFrame, k: int) -> DataFrame:
        return fuse([self.vector(questions, CANDIDATES), self.bm25(questions, CANDIDATES)], k)

    def hybrid_reranked(self, questions: DataFrame, k: int) -> DataFrame:
        found = Scratch(questions.sparkSession).kept(self.hybrid(questions, CANDIDATES), "found")
        # a few numbers a row go to the texts, which are many more
        few = found.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        found = (F.broadcast(found) if few else found).join(self.chunks.select("id", F.col("text")), "id")
        return rerank(found.join(questions.select("qid", F.col("text").alias("question")), "qid"), k, self.scorer)

    def _ask(self, questions: DataFrame, system: str, prompt: str) -> DataFrame:
        """(qid, text) of the questions that were answered; those that were not are added to `failures`. Answers are
        written once, as a model may answer otherwise the next time."""
        scratch = Scratch(questions.sparkSession)
        answers = scratch.kept(ask_all(questions, self.model, system, prompt, self.policy), "answers")
        self.failures.append(answers.filter("error is not null").select("qid", "error", "tries"))
        return answers.filter("error is null").select("qid", "text")

    def hyde(self, questions: DataFrame, k: int) -> DataFrame:
        """Searches with the embedding of a made-up answer; a question without one finds nothing."""
        passages = self._ask(questions, HYDE, "Question: ").withColumn("text", F.trim("text"))
        return self.vector(passages, k)

    def multi_query(self, questions: DataFrame, k: int, variants: int = 3) -> DataFrame:
        """Fuses the hybrid lists of the question and of up to `variants` rephrasings; without any, it is the question's."""
        asked = self._ask(questions, VARIANTS, "Query: ").select("qid", F.posexplode(variant_lines(F.col("text"), variants)).alias("n", "text"))
        forms = asked.select("qid", (F.col("n") + 1).alias("list_no"), "text")
        forms = forms.select(F.xxhash64("qid", "list_no").alias("qid"), "text", F.struct("qid", "list_no").alias("both"))
        lists = self.hybrid(forms.select("qid", "text"), CANDIDATES).join(forms.select("qid", "both"), "qid").select("both.qid", "id", "both.list_no", "rank")
        own = self.hybrid(questions, CANDIDATES).select("qid", "id", F.lit(0).alias("list_no"), "rank")
        return fuse_numbered(own.unionByName(lists), k)
