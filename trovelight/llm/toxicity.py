"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T
from trovelight.llm.langid import id_remainder

GRAMS = (3, 4, 5)
#: Words of a passage; a text is as toxic as its most toxic passage.
PASSAGE = 4
_EDGE = T.mix(np.array([991], np.uint64))[0]


@dataclass
class Subwords:
    """Distinct words of some texts: bucket numbers of their character n-grams and of the word itself, in rows."""

    words: T.Words
    back: np.ndarray  #: number of the distinct word, by word
    bucket: np.ndarray
    row: np.ndarray  #: distinct word of each bucket
    rows: int


def subwords(texts: pa.Array, buckets: int) -> Subwords:
    w = T.words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), separators=T.NOT_ALNUM)
    _, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
    size = w.end[one] - w.start[one] + 2
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(w.start[one] - 1, size)
    values = T.BYTE_VALUES[w.data[np.clip(at, 0, max(len(w.data) - 1, 0))]] if len(at) else np.empty(0, np.uint64)
    values[off[:-1]] = values[off[1:] - 1] = _EDGE
    owner = np.repeat(np.arange(len(one)), size)
    hashes, rows = [w.hash[one]], [np.arange(len(one))]
    for n in GRAMS:
        inner = T.inside_text(off, n)
        if len(inner):
            hashes.append(T.rolling(values, n)[inner])
            rows.append(owner[inner])
    return Subwords(w, back, (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64), np.concatenate(rows), len(one))


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage of each word, and the text of each passage; passages do not cross texts."""
    n = np.diff(first)
    per = -(-n // PASSAGE)
    start = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(n)), n)
    return start[doc] + (np.arange(first[-1]) - first[doc]) // PASSAGE, np.repeat(np.arange(len(n)), per)


def _mean(index: np.ndarray, rows: int, table: np.ndarray, many: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    out = np.empty((rows, table.shape[1]))
    for d in range(table.shape[1]):
        v = table[:, d] if pick is None else table[pick, d]
        out[:, d] = np.bincount(index, weights=v, minlength=rows)
    return out / many[:, None]


@dataclass
class Model:
    margin: np.ndarray  #: by bucket: its embedding times the difference of the two softmax columns
    bias: float


def train(texts: pa.Array, labels: np.ndarray, buckets: int, dims: int = 8, rounds: int = 40, rate: float = 0.03, seed: int = 7, min_texts: int = 5, share: float | None = None) -> Model:
    """Joint gradient descent (Adam) on embeddings and softmax.

    The first dimension starts at how surely a bucket's texts differ in label (log odds over their deviation, small
    ones zero), the others at noise. Negative texts teach by all their passages, positive ones by their currently most
    toxic passage, as only some of their passages are toxic. Buckets that fewer than `min_texts` texts hold keep an
    embedding of zero: they could only be learnt by heart. Every fifth text only judges: the round that orders these
    best by label is kept, and the bias moves to where they part best, label 1 weighing `share` of all.
    """
    rng = np.random.default_rng(seed)
    emb, out = rng.normal(0, 0.1, (buckets, dims)), rng.normal(0, 0.1, (dims, 2))
    bias = np.zeros(2)
    if not len(labels) or labels.min() == labels.max():
        p = (labels.mean() if len(labels) else 0.0) * 0.98 + 0.01
        return Model(np.zeros(buckets, np.float32), float(np.log(p / (1 - p))))
    s = subwords(texts, buckets)
    passage, doc = passages(s.words.first)
    n_pass = len(doc)
    if not n_pass:
        return Model(np.zeros(buckets, np.float32), 0.0)
    y = labels[doc]
    judges = np.arange(len(labels)) % 5 == 4
    best, kept = -1.0, None
    pair = np.unique(s.words.text_of * np.int64(s.rows) + s.back)
    word_of, text_of = pair % s.rows, pair // s.rows
    order = np.argsort(s.row, kind="stable")
    start = np.searchsorted(s.row[order], np.arange(s.rows + 1))
    held = np.zeros((2, buckets))
    for label, judge, text in zip(labels, judges, np.split(word_of[np.argsort(text_of, kind="stable")], np.cumsum(np.bincount(text_of, minlength=len(labels)))[:-1]), strict=True):
        if len(text) and not judge:
            held[label, np.unique(np.concatenate([s.bucket[order[start[x] : start[x + 1]]] for x in text]))] += 1
    rare = held.sum(0) < min_texts
    neg, pos = held[0] + 0.5, held[1] + 0.5
    sure = (np.log(pos / (labels[~judges].sum() + 1)) - np.log(neg / ((1 - labels[~judges]).sum() + 1))) / np.sqrt(1 / pos + 1 / neg)
    emb[:, 0] = np.sign(sure) * np.clip(np.abs(sure) - 2, 0, 8)
    emb[rare] = 0
    out[0] = -1, 1
    in_word, in_pass = np.bincount(s.row, minlength=s.rows), np.bincount(passage, minlength=n_pass)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, out, bias)]
    for t in range(1, rounds + 1):
        word = _mean(s.row, s.rows, emb, in_word, s.bucket)
        vec = _mean(passage, n_pass, word, in_pass, s.back)
        logit = vec @ out + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if t % 4 == 1 and (found := _order(_worst(logit[:, 1] - logit[:, 0], doc, len(labels))[judges], labels[judges])) > best:
            best, kept = found, ((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), logit[:, 1] - logit[:, 0])
        weight = np.where(y == 1, 0.0, 1.0)
        order = np.lexsort((-p[:, 1], doc))
        top = order[np.concatenate([[True], np.diff(doc[order]) != 0])]
        weight[top] = np.where(y[top] == 1, 1.0, 20.0)
        weight[judges[doc]] = 0
        for c in (0, 1):
            total = weight[y == c].sum()
            if total:
                weight[y == c] /= 2 * total
        g = p.copy()
        g[np.arange(n_pass), y] -= 1
        g *= weight[:, None]
        g_out, g_bias = vec.T @ g, g.sum(0)
        g_vec = g @ out.T / in_pass[:, None]
        g_word = _mean(s.back, s.rows, g_vec, in_word, passage)
        g_emb = np.empty_like(emb)
        for d in range(dims):
            g_emb[:, d] = np.bincount(s.bucket, weights=g_word[s.row, d], minlength=buckets)
        g_emb[rare] = 0
        for x, gx, (m, v) in zip((emb, out, bias), (g_emb, g_out, g_bias), moments, strict=True):
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    margin, shift, logit = kept
    return Model(margin, shift - _parting(_worst(logit, doc, len(labels))[judges], labels[judges], share))


def _worst(margin: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    out = np.full(texts, -30.0)
    np.maximum.at(out, doc, margin)
    return out


def _order(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a text of each label that are in order; 0 without such pairs."""
    one, zero = np.sort(score[y == 1]), np.sort(score[y == 0])
    if not len(one) or not len(zero):
        return 0.0
    return float((np.searchsorted(zero, one) + np.searchsorted(zero, one, "right")).mean() / 2 / len(zero))


def _parting(score: np.ndarray, y: np.ndarray, share: float | None) -> float:
    """The cut with the best F1, between two scores; 0 if only one label is there."""
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return 0.0
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    order = np.argsort(-score, kind="stable")
    hits, taken = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + share)
    f1[:-1][score[order][:-1] == score[order][1:]] = -1
    i = int(f1.argmax())
    below = score[order][i + 1] if i + 1 < len(y) else score[order][i] - 1
    return float((score[order][i] + below) / 2)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text of one slice; a text without words has the bias alone, at most 0.25."""
    s = subwords(texts, len(model.margin))
    word = np.bincount(s.row, weights=model.margin[s.bucket], minlength=s.rows) / np.maximum(np.bincount(s.row, minlength=s.rows), 1)
    passage, doc = passages(s.words.first)
    margin = np.bincount(passage, weights=word[s.back], minlength=len(doc)) / np.maximum(np.bincount(passage, minlength=len(doc)), 1)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, margin)
    best = np.where(np.isinf(best), min(0.0, -1.1 - model.bias), best) + model.bias
    return 1 / (1 + np.exp(-np.clip(best, -500, 500)))


def _fit(buckets: int, share: float):
    def run(table: pa.Table) -> pa.Table:
        table = S.sorted_rows(table, "k", "text")
        m = train(S.one_array(table["text"]), table["label"].to_numpy().astype(np.int64), buckets, share=share)
        return pa.table({"margin": pa.array([m.margin.tobytes()], pa.binary()), "bias": pa.array([m.bias])})

    return run


def _predict(shared_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch.column("text")):
                p = score_texts(shared_model.value, batch.column("text").slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["k", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, max_train_docs: int = 4_000, buckets: int = 1 << 16) -> DataFrame:
    """Scores every whole text for toxicity, learning from labelled documents outside the held-out fold.

    A word is the mean embedding of its hashed character 3- to 5-grams and itself, so misspellings share most of it; a
    passage is the mean of its words, and a text scores as its most toxic passage. Fits on about `max_train_docs`
    labelled documents, half of each label where there are enough, chosen by a hash of the id; the model is `buckets`
    floats. Conflicting labels of one id: the highest counts.

    Returns doc_id, held_out, score, predicted, one row per input row. Null or empty texts score by the bias, below
    0.5. Null labels do not teach; without labels of both kinds every text gets the label share. A null id has no label.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(S.NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"), (id_remainder(id_col, folds) == held_out).alias("held_out"))
    taught = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (id_remainder(id_col, folds) != held_out))
    taught = taught.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in taught.filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(counts.get(0, 0) + counts.get(1, 0), 1)
    odds = F.lit(0)
    for label in (0, 1):
        want = min(1.0, max_train_docs / 2 / counts[label]) if counts.get(label) else 0.0
        odds = F.when(F.col("label") == label, F.lit(int(want * 1_000_000))).otherwise(odds)
    chosen = taught.filter(F.pmod(F.xxhash64("k", F.lit("toxic")), F.lit(1_000_000)) < odds)
    # about max_train_docs ids, by the filter above
    sample = rows.select("k", "text").join(F.broadcast(chosen), "k")
    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fit(buckets, share), "margin binary, bias double").toArrow()
    if fitted.num_rows:
        model = Model(np.frombuffer(fitted["margin"][0].as_py(), np.float32), fitted["bias"][0].as_py())
    else:
        model = Model(np.zeros(buckets, np.float32), -4.6)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_predict(shared_model), "k long, held_out boolean, score double, predicted int")
    return out.select(S.id_back().alias(id_col), "held_out", "score", "predicted")
