"""Language ID by word-first backoff."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T

LONGEST = 5
_NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_EDGE = T.mix(np.array([977], np.uint64))[0]


#: Added to each count, so that a key unseen in a language has a frequency there.
SMOOTH = 0.1


@dataclass
class Table:
    """Log frequencies of words, or of n-grams of one length. A key that a language has not seen has `floor` there; the
    entries from begin[i] to begin[i + 1] say what key i has above it in the languages that have seen it."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    above: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, c: np.ndarray, langs: int) -> Table:
        order = np.lexsort((lang, key))
        key, lang, c = key[order], lang[order], c[order].astype(np.float64)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        total = np.bincount(lang, weights=c, minlength=langs) + SMOOTH * (len(new) + 1)
        return cls(key[new], np.append(new, len(key)), lang.astype(np.int32), np.log1p(c / SMOOTH).astype(np.float32), np.log(SMOOTH / total))

    def sums(self, found: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Sum of the log frequencies by language of the keys numbered `found`, by owner."""
        langs = len(self.floor)
        many = self.begin[found + 1] - self.begin[found]
        at = np.repeat(self.begin[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        seen = np.bincount(np.repeat(owner, many) * langs + self.lang[at], weights=self.above[at], minlength=owners * langs)
        return seen.reshape(owners, langs) + np.bincount(owner, minlength=owners)[:, None] * self.floor


@dataclass
class Model:
    """tables[0] has words, tables[n] character n-grams of words (in bytes, with word edges)."""

    langs: list[str]
    tables: list[Table] = field(default_factory=list)


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _edged(w: T.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte values of the picked words, each between two edge marks, and the offsets of the words."""
    size = w.end[pick] - w.start[pick] + 2
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(w.start[pick] - 1, size)
    edge = np.zeros(off[-1], bool)
    edge[off[:-1]] = edge[off[1:] - 1] = True
    values = T.BYTE_VALUES[w.data[np.clip(at, 0, max(len(w.data) - 1, 0))]] if len(at) else np.empty(0, np.uint64)
    values[edge] = _EDGE
    return values, off


def _grams(values: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that stay inside a word, and the word of each."""
    at = T.inside_text(off, n)
    if not len(at):
        return np.empty(0, np.uint64), at
    return T.rolling(values, n)[at], np.repeat(np.arange(len(off) - 1), np.diff(off))[at]


def _training_counts(langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            texts = _lowered(batch.column("text"))
            for lo, hi in T.slices(texts):
                w = T.words(texts.slice(lo, hi - lo), separators=_NOT_LETTER)
                of = lang[lo:hi][w.text_of]
                for x in np.unique(of):
                    u, one, c = np.unique(w.hash[of == x], return_index=True, return_counts=True)
                    held.setdefault((0, int(x)), []).append((u, c))
                    values, off = _edged(w, np.flatnonzero(of == x)[one])
                    for n in range(1, LONGEST + 1):
                        h, owner = _grams(values, off, n)
                        g, back = np.unique(h, return_inverse=True)
                        held.setdefault((n, int(x)), []).append((g, np.bincount(back, weights=c[owner], minlength=len(g)).astype(np.int64)))
        for (n, x), pairs in held.items():
            u, back = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            c = np.bincount(back, weights=np.concatenate([c for _, c in pairs])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n, np.int32)), pa.array(u.view(np.int64)), pa.array(np.full(len(u), x, np.int32)), pa.array(c)], names=["n", "key", "lang", "c"])

    return run


def training_sample(rows: DataFrame, max_train_docs: int, max_train_bytes: int) -> DataFrame:
    """About max_train_docs and max_train_bytes of (u, text, lang), every language with an equal share of both as far as
    it has texts, chosen by a hash of id and text. Equal rows of one id count once."""
    sizes = rows.select("u", "lang", F.octet_length("text").alias("size"))
    per = sizes.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))
    many = per.agg(F.count("*").alias("langs"))
    # one number
    per = per.join(F.broadcast(many)).select("lang", F.least(F.lit(max_train_docs) / F.col("docs"), F.lit(max_train_bytes) / F.greatest("bytes", F.lit(1))).alias("share"), "langs")
    draw = F.pmod(F.xxhash64("u", F.lit("train")), F.lit(1_000_000)) < F.lit(1_000_000) * F.col("share") / F.col("langs")
    chosen = sizes.join(per, "lang").filter(draw).select("u").distinct()
    # about max_train_docs keys, by the filter above
    return rows.join(F.broadcast(chosen), "u", "left_semi").dropDuplicates(["u"])


def train(rows: DataFrame, max_train_docs: int, max_train_bytes: int) -> Model:
    """rows: (u, text, lang). All words and n-grams of the training sample are kept, so the model is bounded by the
    sample: no more entries than it has words and n-grams."""
    sample = S.written(training_sample(rows.filter("lang is not null and text is not null"), max_train_docs, max_train_bytes).select("text", "lang"), "sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    model = Model(langs)
    if not langs:
        return model
    counts = S.written(sample.mapInArrow(_training_counts(langs), "n int, key long, lang int, c long").groupBy("n", "key", "lang").agg(F.sum("c").alias("c")), "langcounts")
    for n in range(LONGEST + 1):
        t = counts.filter(F.col("n") == n).select("key", "lang", "c").toArrow()
        model.tables.append(Table.of(t["key"].to_numpy().view(np.uint64), t["lang"].to_numpy(), t["c"].to_numpy(), len(langs)))
    S.discard(sample, counts)
    return model


def _look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def word_scores(model: Model, w: T.Words, one: np.ndarray) -> np.ndarray:
    """Score by language of the words numbered `one`: the word's log frequency, or for an unseen word the mean log
    frequency of its known n-grams of the longest length that has any; 0 if none has."""
    out = np.zeros((len(one), len(model.langs)))
    known, at = _look_up(model.tables[0].keys, w.hash[one])
    hit = np.flatnonzero(known)
    out[hit] = model.tables[0].sums(at[hit], np.arange(len(hit)), len(hit))
    todo = np.flatnonzero(~known)
    for n in range(LONGEST, 0, -1):
        if not len(todo):
            break
        values, off = _edged(w, one[todo])
        h, owner = _grams(values, off, n)
        hit, at = _look_up(model.tables[n].keys, h)
        owner, at = owner[hit], at[hit]
        many = np.bincount(owner, minlength=len(todo))
        has = many > 0
        out[todo[has]] = model.tables[n].sums(at, owner, len(todo))[has] / many[has][:, None]
        todo = todo[~has]
    return out


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability by language of each text of one slice."""
    low = _lowered(texts)
    w = T.words(low, separators=_NOT_LETTER)
    _, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
    per = word_scores(model, w, one)
    per -= per.mean(1, keepdims=True)
    n = np.diff(w.first)
    total = np.empty((len(n), len(model.langs)))
    for x in range(len(model.langs)):
        c = np.concatenate([[0.0], np.cumsum(per[back, x], dtype=np.float64)])
        total[:, x] = c[w.first[1:]] - c[w.first[:-1]]
    total /= np.sqrt(np.maximum(n, 1))[:, None]
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _predict(shared_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        for batch in batches:
            texts = batch.column("text")
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False))
            for lo, hi in T.slices(texts):
                if model.langs:
                    p = score_texts(model, texts.slice(lo, hi - lo))
                    best, score = p.argmax(1), p.max(1)
                else:
                    best, score = np.zeros(hi - lo, int), np.zeros(hi - lo)
                ok = letters[lo:hi] & bool(model.langs)
                names = [model.langs[b] if x else "und" for b, x in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))], names=["k", "held_out", "lang_pred", "score"])

    return run


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def detect_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, max_train_docs: int = 8_000, max_train_bytes: int = 24 << 20, key_col: str | None = None) -> DataFrame:
    """Predicts the language of each whole text, learning from labelled documents outside the held-out fold.

    Known words score by their log frequency in each language, unseen ones by progressively shorter character
    n-grams. Words are lower-cased runs of letters. The score is the predicted language's share after a softmax over
    word evidence divided by the root of the word count. Learns from a sample of about max_train_docs documents and
    max_train_bytes of text, in which each language has an equal share as far as it has texts; all words and n-grams of
    the sample are kept.

    Returns doc_id (or key_col in its place; folds still go by id), held_out, lang_pred, score, one row per input row. Null
    text, or one without letters: `und`, 0.
    Without labels everything is `und`. Repeated rows each return; equal rows of one id teach once. Ties go to the first
    language by name.
    """
    key_col = key_col or id_col
    k, text = F.coalesce(F.col(key_col).cast("long"), F.lit(S.NO_ID)), F.col(text_col).cast("string")
    # which rows are learned from goes by id too, whatever the key
    own = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(S.NO_ID)), text)
    rows = docs.select(k.alias("k"), own.alias("u"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), (id_remainder(id_col, folds) == held_out).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")).select("u", "text", "lang"), max_train_docs, max_train_bytes)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.select("k", "text", "held_out").mapInArrow(_predict(shared_model), "k long, held_out boolean, lang_pred string, score double")
    return out.select(S.id_back().alias(key_col), "held_out", "lang_pred", "score")
