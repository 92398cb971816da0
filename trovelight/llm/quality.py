"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Metric: (integer value of a document, lower fence too?, slack beside the fences). Values are bins of the sketch.
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", False, 50),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", False, 100),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", False, 100),
    "length": ("least(100 * word_chars div greatest(n_words, 1), 100000)", True, 100),
}


def _sums(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return c[edges[1:]] - c[edges[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of one slice."""
    w = T.words(texts)
    n, docs = len(w.data), len(texts)
    n_words = np.diff(w.first)
    white = T.WHITE[w.data]
    chars = _sums(~white & ((w.data & 0xC0) != 0x80), w.offsets)
    symbols = _sums(_SYMBOL[w.data], w.offsets)
    cut = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate([w.offsets[:-1], cut + 1]))
    begin = begin[begin < n]
    owner = np.searchsorted(w.offsets, begin, "right") - 1
    stop = np.minimum(np.append(cut, n)[np.searchsorted(cut, begin)], w.offsets[owner + 1])
    worded = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop, owner = begin[worded], stop[worded], owner[worded]
    line = T.span_hash(T.BYTE_VALUES[w.data], begin, stop) ^ T.mix(owner.astype(np.uint64))
    _, one = np.unique(line, return_index=True)
    n_lines = np.bincount(owner, minlength=docs)
    dup = n_lines - np.bincount(owner[one], minlength=docs)
    at = T.inside_text(w.first, 3)
    h = T.rolling(w.hash, 3)[at] if len(at) else np.empty(0, np.uint64)
    _, back, c = np.unique(h ^ T.mix(w.text_of[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    again = at[c[back] > 1]
    covered = np.zeros(len(w.start), bool)
    for j in range(3):
        covered[again + j] = True
    return dict(zip(_COUNTS, (n_words, chars, symbols, n_lines, dup, _sums(covered, w.first)), strict=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in T.slices(texts):
            c = text_counts(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in ("k", "lang", "source")), *(pa.array(c[x].astype(np.int64)) for x in _COUNTS)], names=["k", "lang", "source", *_COUNTS])


def fences(counts: DataFrame, min_group: int) -> DataFrame:
    """Low and high bound of each metric for each (lang, source), from sketches of (bin, count).

    A sketch is the count of documents by integer bin; sketches merge by adding. A group of fewer than `min_group`
    documents takes its language's merged sketch, and a small language that of all documents.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).alias("bin")) for m, (e, _, _) in METRICS.items())))
    own = counts.filter("n_words > 0").select("lang", "source", parts.alias("x")).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("c"))
    own = S.written(own, "sketches")

    def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "metric")
        run = sketch.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        per = run.groupBy(*keys, "metric").agg(F.first("n").alias("n"), *(F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 3)))
        return per.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("metric") == m, F.struct("q1", "q3"))).alias(m) for m in METRICS))

    lang_sketch = own.groupBy("lang", "metric", "bin").agg(F.sum("c").alias("c"))
    all_sketch = own.groupBy("metric", "bin").agg(F.sum("c").alias("c"))
    groups, langs = quantiles(own, ["lang", "source"]), quantiles(lang_sketch, ["lang"]).select(F.col("lang").alias("l"), F.struct("n", *METRICS).alias("by_lang"))
    whole = quantiles(all_sketch, []).select(F.struct("n", *METRICS).alias("by_all"))
    # one row, by construction
    joined = groups.select("lang", "source", F.struct("n", *METRICS).alias("own")).join(langs, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(whole))
    pick = F.when(F.col("own.n") >= min_group, F.col("own")).when(F.col("by_lang.n") >= min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    joined = joined.select("lang", "source", pick.alias("p"))
    bounds = []
    for m, (_, lower, slack) in METRICS.items():
        q1, q3 = F.col(f"p.{m}.q1"), F.col(f"p.{m}.q3")
        bounds.append((q3 + 3 * (q3 - q1) + slack).alias(f"{m}_high"))
        if lower:
            bounds.append((q1 - 3 * (q3 - q1) - slack).alias(f"{m}_low"))
    return joined.select("lang", "source", *bounds)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_group: int = 200) -> DataFrame:
    """Base counts, fixed base rules, and the verdict of adaptive fences per language and source.

    A metric's fences are its first and third quartile, widened by three times their distance and a slack, read from
    histogram sketches with integer bins, which merge without loss and in any order. Documents without words are not
    in the sketches.

    Returns doc_id, the counts, base_failed, kept and reasons (broken fences), one row per input row. Null or empty
    text: zero counts, base_failed. Null language or source is a group of its own. Repeated rows each count and return.
    """
    take = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(S.NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counts = S.written(take.mapInArrow(_count, "k long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)), "counts")
    limits = fences(counts, min_group).withColumnsRenamed({"lang": "l", "source": "s"})
    judged = counts.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    broken = []
    for m, (e, lower, _) in METRICS.items():
        value = F.expr(e)
        out = value > F.col(f"{m}_high")
        broken.append(F.when(out | (value < F.col(f"{m}_low")) if lower else out, F.lit(m)))
    judged = judged.withColumn("base_failed", failed).withColumn("reasons", F.array_compact(F.array(*broken)))
    return judged.select(S.id_back().alias(id_col), F.col("lang").alias(lang_col), F.col("source").alias(source_col), *_COUNTS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
