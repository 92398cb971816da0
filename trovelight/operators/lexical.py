"""BM25 over a batch of queries: each text is counted and scored where it lies, and only the best leave a task. Postings that
do not lie by text are joined on their terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.functions.text import tokenize
from trovelight.sources.scratch import Scratch

K1, B = 1.2, 0.75
#: Before a number, stands for the text itself; terms have letters and digits only. The number, a hash of the id modulo
#: SALTS, deals these rows over tasks where terms are joined by a shuffle.
WHOLE, SALTS = "~", 64
#: Pairs of question and term, of some fifty bytes each, that go to every task; more are joined as Spark plans it.
BROADCAST_TERMS = 500_000
#: Pairs of question and posting, and of question and text, that a task scores at a time.
PAIRS = 1 << 20


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))


def term_freq(tokens: DataFrame) -> DataFrame:
    """(id, tokens) to (id, term, tf, dl)."""
    each = tokens.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")


def term_freq_by_text(tokens: DataFrame) -> DataFrame:
    """term_freq where every id stands on one row: a text's sorted tokens are counted by the places where the token changes,
    without a shuffle."""
    rows = tokens.filter(F.size("tokens") > 0).select("id", F.array_sort("tokens").alias("s"))
    n = F.size("s")
    changes = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.select("id", "s", changes.alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(n))
    each = rows.select("id", "s", n.cast("long").alias("dl"), F.explode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("z"))
    return each.select("id", F.get("s", F.col("z.a")).alias("term"), (F.col("z.b") - F.col("z.a")).cast("long").alias("tf"), "dl")


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n, avgdl), over all texts, empty ones included."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def corpus_sums(tokens: DataFrame) -> DataFrame:
    """One row (n, read, length): texts, those that are not null, and their tokens. Sums of parts add up."""
    size = F.size("tokens").cast("long")
    return tokens.agg(F.count("*").alias("n"), F.count("tokens").alias("read"), F.coalesce(F.sum(F.when(F.col("tokens").isNotNull(), size)), F.lit(0)).alias("length"))


def stats_of(sums: DataFrame) -> DataFrame:
    """Rows of corpus_sums to one row (n, avgdl)."""
    added = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "read", "length")))
    return added.select("n", F.when(F.col("read") > 0, F.col("length") / F.col("read")).otherwise(0.0).alias("avgdl"))


@dataclass(frozen=True)
class LexicalIndex:
    """Postings, document frequencies and corpus statistics, as DataFrames."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    #: (id, dl, terms, counts), terms as places in `vocabulary`: the texts whose id stands on one row, if they were counted
    #: one by one; `rest` has the postings of the others, or is None if there are no others.
    texts: DataFrame | None = None
    rest: DataFrame | None = None
    vocabulary: pa.Array | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str) -> LexicalIndex:
        tokens = tokenized(docs, id_col, text_col)
        postings = term_freq(tokens)
        return cls(postings, doc_freq(postings), corpus_stats(tokens))

    @classmethod
    def for_queries(cls, docs: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> LexicalIndex:
        """The index as far as queries (qid, text) need it, from one pass over the texts.

        Up to BROADCAST_TERMS terms go to the tasks, which write each text's counts of them as one row. Rows of one id are
        one text where their lengths are equal, as in term_freq, and rows without id count as such; these are put together
        afterwards. With more terms, postings are counted by a shuffle.
        """
        words = query_terms(queries).select("term").distinct().orderBy("term").limit(BROADCAST_TERMS + 1).toArrow()["term"].combine_chunks()
        if len(words) > BROADCAST_TERMS:
            return cls._by_shuffle(docs, id_col, text_col, queries)
        scratch = Scratch(docs.sparkSession)
        tokens = tokenized(docs, id_col, text_col)
        kind = tokens.schema["id"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(words)
        texts = scratch.kept(tokens.mapInArrow(_counted(shared), f"id {kind}, dl long, terms array<int>, counts array<int>"), "texts")
        stats = scratch.kept(texts.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")), "stats")
        numbered = docs.sparkSession.createDataFrame(pa.table({"number": pa.array(np.arange(len(words)), pa.int32()), "term": words.cast(pa.string())}))

        def postings_of(rows: DataFrame) -> DataFrame:
            each = rows.select("id", "dl", F.explode(F.arrays_zip("terms", "counts")).alias("z"))
            named = each.select("id", "dl", F.col("z.terms").alias("number"), F.col("z.counts").cast("long").alias("tf")).join(F.broadcast(numbered), "number")
            return named.select("id", "term", "tf", "dl")

        again = texts.groupBy("id").count().filter("count > 1 or id is null").select(F.col("id").alias("again"))
        alone, rest = texts, None
        if not again.isEmpty():
            again, same = scratch.kept(again, "again"), F.col("id").eqNullSafe(F.col("again"))
            alone = texts.join(again, same, "left_anti")
            # rows of one id and length are one text
            rest = postings_of(texts.join(again, same, "left_semi")).groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf")).select("id", "term", "tf", "dl")
            rest = scratch.kept(rest, "rest")
        df = alone.select(F.explode("terms").alias("number")).groupBy("number").count().join(F.broadcast(numbered), "number").select("term", F.col("count").alias("df"))
        if rest is not None:
            df = df.unionByName(doc_freq(rest)).groupBy("term").agg(F.sum("df").alias("df"))
        postings = postings_of(alone) if rest is None else postings_of(alone).unionByName(rest)
        return cls(postings, scratch.kept(df, "frequencies"), stats, alone, rest, words)

    @classmethod
    def _by_shuffle(cls, docs: DataFrame, id_col: str, text_col: str, queries: DataFrame) -> LexicalIndex:
        """for_queries of any number of terms. Only terms of queries go on from the tokens, and one row a text for the
        statistics. All three tables come from the same counts without filters of their own, so that they share the exchange."""
        marks = queries.sparkSession.range(SALTS).select(F.concat(F.lit(WHOLE), F.col("id").cast("string")))
        wanted = query_terms(queries).select("term").union(marks).distinct()
        texts = tokenized(docs, id_col, text_col)
        mark = F.concat(F.lit(WHOLE), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string"))
        terms = F.concat(F.array(mark), F.coalesce("tokens", F.array().cast("array<string>")))
        each = texts.select("id", F.size("tokens").cast("long").alias("dl"), F.explode(terms).alias("term")).join(wanted, "term", "left_semi")
        counted = each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
        # df reads tf, or else its branch would lose that column and count anew
        by_term = counted.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("texts"), F.sum(F.when(F.col("dl").isNotNull(), F.col("tf"))).alias("read"), F.sum(F.col("tf") * F.col("dl")).alias("length"))
        whole = lambda c: F.sum(F.when(F.startswith("term", F.lit(WHOLE)), F.col(c)))
        stats = by_term.agg(F.coalesce(whole("texts"), F.lit(0)).alias("n"), F.coalesce(whole("length") / whole("read"), F.lit(0.0)).alias("avgdl"))
        return cls(counted, by_term.select("term", "df"), stats)


def _counted(shared):
    """Each text's tokens as its length and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            tokens = batch.column("tokens")
            size = tokens.value_lengths()
            number = pc.index_in(tokens.flatten(), value_set=words)
            known = np.asarray(number.is_valid())
            row = np.repeat(np.arange(batch.num_rows), np.asarray(size.fill_null(0)))[known]
            key, count = np.unique(row * max(1, len(words)) + np.asarray(number.drop_null()), return_counts=True)
            row, term = np.divmod(key, max(1, len(words)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), size.cast(pa.int64()), *lists], names=["id", "dl", "terms", "counts"])

    return run


def _best_of_texts(shared, k: int, k1: float, b: float):
    """Scores texts against all queries, some at a time, and keeps each query's k best of the task, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, starts, asked, weight, avgdl = shared.value
        n_q, best_q, best_s, best_id = len(qids), np.empty(0, np.int64), np.empty(0), None
        least = np.full(n_q, np.nextafter(0, 1))  # the k-th best score so far; scores are above 0
        most = max(PAIRS, 4 * n_q * k)
        for batch in batches:
            terms = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(terms.value_lengths()))
            term = np.asarray(terms.flatten())
            each = starts[term + 1] - starts[term]
            tf, dl = np.asarray(batch.column("counts").flatten(), np.float64), np.asarray(batch.column("dl").fill_null(0), np.float64)
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            part = np.cumsum(np.bincount(row, each, batch.num_rows) + n_q) // most
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for first, last in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                of = slice(*np.searchsorted(row, (first, last)))
                n, width = each[of], last - first
                place = np.repeat(starts[term[of]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = asked[place] * width + np.repeat(row[of] - first, n)
                scores = np.round(np.bincount(cell, weight[place] * np.repeat(gain[of], n), n_q * width).reshape(n_q, width), 6)
                q, i = np.nonzero(scores >= least[:, None])
                if not len(q):
                    continue
                ids = batch.column("id").take(pa.array(first + i))
                ids = ids if best_id is None else pa.concat_arrays([best_id, ids])
                q, s = np.concatenate([best_q, q]), np.concatenate([best_s, scores[q, i]])
                order = np.lexsort((np.asarray(pc.rank(ids, tiebreaker="dense")), -s, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                kth = order[place == k - 1]
                least[q[kth]] = s[kth]
                order = order[place < k]
                best_q, best_s, best_id = q[order], s[order], ids.take(pa.array(order))
        if best_id is not None:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best_q)), best_id, pa.array(best_s)], names=["qid", "id", "score"])

    return run


def _shared_weights(index: LexicalIndex, weights: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, float]:
    """The queries, and by place in the vocabulary where its pairs of query and weight start, these, and the mean length."""
    coded = weights["qid"].combine_chunks().dictionary_encode("encode")
    number = np.asarray(pc.index_in(weights["term"].combine_chunks(), value_set=index.vocabulary))
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(index.vocabulary) + 1))
    return coded.dictionary, starts, np.asarray(coded.indices, np.int64)[order], np.asarray(weights["weight"], np.float64)[order], weights["avgdl"][0].as_py() if len(weights) else 0.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, text) to (qid, term, qtf)."""
    return queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def top_k(scored: DataFrame, k: int, query: str = "qid", order: tuple[Column, ...] = ()) -> DataFrame:
    """The k best rows of each query with their rank; the planner limits each partition first."""
    w = Window.partitionBy(query).orderBy(*(order or (F.desc("score"), F.col("id"))))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(index: LexicalIndex, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """queries: (qid, text). Returns (qid, id, score, rank), the k best with a score above 0, ties by id.

    Scores are rounded to six digits. Repeated query terms count as often as they occur. Only postings of query terms
    are joined; statistics come in as one broadcast row, and weights of up to BROADCAST_TERMS query terms too. With that
    few, texts that the index holds one a row are scored where they lie, and each task hands on its k best a query; other
    postings are joined, and summed by query and text.
    """
    terms = query_terms(queries)
    # one row of two numbers
    weighted = terms.join(index.frequencies, "term").join(F.broadcast(index.stats))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = weighted.select("qid", "term", (idf * F.col("qtf")).alias("weight"), "avgdl")
    few, tf = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS, F.col("tf")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    def joined(postings: DataFrame) -> DataFrame:
        scored = postings.join(F.broadcast(weighted) if few else weighted, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
        return scored.filter("score > 0")

    if index.texts is None or not few or isinstance(terms.schema["qid"].dataType, (T.ArrayType, T.MapType, T.StructType)):
        return top_k(joined(index.postings), k)
    shared = queries.sparkSession.sparkContext.broadcast(_shared_weights(index, weighted.toArrow()))
    kinds = [frame.schema[c].dataType.simpleString() for frame, c in ((terms, "qid"), (index.texts, "id"))]
    found = index.texts.mapInArrow(_best_of_texts(shared, k, k1, b), "qid {}, id {}, score double".format(*kinds))
    return top_k(found if index.rest is None else found.unionByName(joined(index.rest)), k)


def holders(docs: DataFrame, runs: DataFrame, doc_id: str, run_id: str) -> DataFrame:
    """docs: (doc_id, words), runs: (run_id, words), of three words each. (run_id, doc_id) where the three stand in a row,
    once for each place.

    Up to BROADCAST_TERMS runs go to the tasks, which look for them by their words' numbers; with more, hashes of all runs
    of the docs are joined, so that a clash can add a pair.
    """
    few = runs.select(run_id, "words").limit(BROADCAST_TERMS + 1).toArrow()
    if few.num_rows > BROADCAST_TERMS:
        hashed = lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(3)))
        every = docs.filter(F.size("words") > 2).select(doc_id, F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 3), hashed)).alias("run"))
        return every.join(runs.select(run_id, hashed(F.lit(0)).alias("run")), "run").select(run_id, doc_id)
    words = few["words"].combine_chunks().flatten()
    vocabulary = pc.unique(words)
    number = np.asarray(pc.index_in(words, value_set=vocabulary), np.int64).reshape(-1, 3)
    keys = (number[:, 0] * len(vocabulary) + number[:, 1]) * len(vocabulary) + number[:, 2]
    named = docs.sparkSession.createDataFrame(pa.table({run_id: few[run_id], "run": pa.array(keys, pa.int64())}))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.unique(keys)))
    found = docs.mapInArrow(_runs_of_words(shared, doc_id), f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, run long")
    return found.join(F.broadcast(named), "run").select(run_id, doc_id)


def _runs_of_words(shared, doc_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, keys = shared.value
        for batch in batches:
            words = batch.column("words")
            number = np.asarray(pc.index_in(words.flatten(), value_set=vocabulary).fill_null(-1), np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(words.value_lengths().fill_null(0)))
            if len(row) < 3 or not len(keys):
                continue
            at = np.flatnonzero((number[:-2] >= 0) & (number[1:-1] >= 0) & (number[2:] >= 0) & (row[:-2] == row[2:]))
            key = (number[at] * len(vocabulary) + number[at + 1]) * len(vocabulary) + number[at + 2]
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(row[at[hit]])), pa.array(key[hit])], names=[doc_id, "run"])

    return run
