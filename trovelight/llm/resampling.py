"""Importance resampling towards a target distribution: hashed n-gram histograms, gains, and a seeded weighted draw.

Texts are cut into words by the Regex Split of `tokenizers`, which is not trained. Its offset pairs say where each word
lies in the text's bytes, and windows of one to three words are hashed from there.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from trovelight.llm import shared as S
from trovelight.llm.textarrays import slices

#: Everything that is no digit, letter a-z or byte beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that the splitter takes at a time; longer texts are cut between words.
PIECE = 1 << 14
#: Words longer than this are hashed one by one.
LONG_WORD = 64
#: Rows that are put in order together, and the most such groups.
RUN_ROWS, RUNS = 50_000, 10_000
#: Equal rows that are ranked in one go.
EQUAL_ROWS = 4096

_is_separator = np.array([c < 128 and not (48 <= c < 58 or 97 <= c < 123) for c in range(256)])
_steps = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _steps = np.where(_steps & 1, (_steps >> 1) ^ np.uint32(0xEDB88320), _steps >> 1)
_ALL = np.uint32(0xFFFFFFFF)


def splitter() -> pre_tokenizers.Split:
    return pre_tokenizers.Split(Regex(SEPARATORS), "removed")


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The text's bytes in pieces of about PIECE, cut at separators: (start, bytes)."""
    at, n = 0, len(data)
    if n <= PIECE:
        yield 0, data
        return
    cuts = np.flatnonzero(_is_separator[np.frombuffer(data, np.uint8)])
    while at < n:
        end = n
        if n - at > PIECE:
            i = int(np.searchsorted(cuts, at + PIECE, "right"))
            if i and cuts[i - 1] > at:
                end = int(cuts[i - 1])
            elif i < len(cuts):
                end = int(cuts[i])
        yield at, data[at:end]
        at = end


def word_spans(split: pre_tokenizers.Split, data: bytes) -> np.ndarray:
    """(n, 2): where each word of a lower-cased text starts and ends, in bytes."""
    out = []
    for base, piece in pieces(data):
        text = piece.decode("utf-8")
        spans = [span for _, span in split.pre_tokenize_str(text)]
        if spans:
            ends = np.array(spans, np.int64)
            if len(text) != len(piece):  # offsets count characters
                starts = np.flatnonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80)
                ends = np.append(starts, len(piece))[ends]
            out.append(ends + base)
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case, and nothing else changed."""
    return (text or "").encode("utf-8", "replace").lower()


def _after_space(state: np.ndarray) -> np.ndarray:
    return _steps[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))


def _after_words(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes start:end each."""
    out = state.copy()
    size = end - start
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    short = np.flatnonzero(size <= LONG_WORD)
    short = short[np.argsort(-size[short], kind="stable")]
    register, at, size = out[short], start[short], size[short]
    longest = int(size[0]) if len(size) else 0
    still = np.searchsorted(-size, -np.arange(longest), "left")  # words longer than j
    for j in range(longest):
        r = register[: still[j]]
        register[: still[j]] = _steps[(r ^ data[at[: still[j]] + j]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[short] = register
    return out


def window_buckets(data: np.ndarray, spans: np.ndarray, first: np.ndarray, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every window of one to max_words words that does not leave its text. first: number of each
    text's first word, and the count at the end. A window's hash goes on from that of the window one word shorter."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][text_of]
    i = np.arange(len(spans))
    state = _after_words(np.full(len(spans), _ALL), data, spans[:, 0], spans[:, 1])
    owners, hashes = [text_of], [state ^ _ALL]
    for n in range(1, max_words):
        more = i + n < last[i]
        i, state = i[more], state[more]
        state = _after_words(_after_space(state), data, spans[i + n, 0], spans[i + n, 1])
        owners.append(text_of[i])
        hashes.append(state ^ _ALL)
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


FEATURES = "k long, n_words long, n_features long, packed binary"


def _features(max_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("k")
            for lo, hi in slices(texts):
                rows = [lowered(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                spans = [word_spans(split, r) for r in rows]
                starts = np.cumsum([0, *map(len, rows)])
                first = np.cumsum([0, *map(len, spans)])
                moved = np.concatenate([s + o for s, o in zip(spans, starts[:-1], strict=True)])
                owner, bucket = window_buckets(np.frombuffer(b"".join(rows), np.uint8), moved, first, max_words, buckets)
                order = np.lexsort((bucket, owner))
                bucket = bucket[order]
                edge = np.searchsorted(owner[order], np.arange(len(rows) + 1))
                packed = [S.pack_sorted(bucket[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array(packed, pa.binary())], names=["k", "n_words", "n_features", "packed"])

    return run


def features(docs: DataFrame, id_col: str | None, text_col: str, max_words: int = 3, buckets: int = 10_000) -> DataFrame:
    """(k, n_words, n_features, packed): the buckets of every text's windows, sorted and packed. One row per input row."""
    k = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(k.alias("k"), F.col(text_col).cast("string").alias("text")).mapInArrow(_features(max_words, buckets), FEATURES)


def _unpacked(batch: pa.RecordBatch, buckets: int) -> list[np.ndarray]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    sizes = batch.column("n_features").to_pylist()
    return [np.cumsum(S.unpack(p, n, kind), dtype=kind) if n else np.empty(0, kind) for p, n in zip(batch.column("packed").to_pylist(), sizes, strict=True)]


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in _unpacked(batch, buckets):
                total += np.bincount(row, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    return run


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends each bucket once."""
    counted = rows.select("n_features", "packed").mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[np.asarray(counted["bucket"])] = np.asarray(counted["n"])
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the log ratio of its smoothed shares in target and source, in thousandths, rounded down."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_s + n)) / float((s + 1) * (all_t + n)))) for s, t in pairs], np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[row].sum()) for row in _unpacked(batch, len(gain))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], names=["k", "n_words", "n_features", "weight"])

    return run


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds rank to a written table of (k, n_words, n_features, weight, score): 1, 2, ... down the scores of texts of
    min_words or more, ties to the smaller k, null beyond `percent` of their number.

    An approximate quantile a little below the cut tells candidates from rows that cannot be drawn. Candidates are counted
    by equal rows, which a hot key cannot fill, and dealt by score into runs of about RUN_ROWS; a run's rank starts where
    those above end, so that no order passes one task.
    """
    fit = F.col("n_words") >= min_words
    no_rank = scored.withColumn("rank", F.lit(None).cast("long"))
    n = scored.filter(fit).count()
    take = n * percent // 100
    if not take:
        return no_rank
    runs = max(1, min(RUNS, -(-take // RUN_ROWS)))
    share = min(1.0, take / n + 0.005)
    cuts = scored.filter(fit).agg(F.percentile_approx("score", [1 - share * (runs - i) / runs for i in range(runs)], 100_000)).first()[0]
    if scored.filter(fit & (F.col("score") >= cuts[0])).count() < take:
        cuts = [scored.filter(fit).agg(F.min("score")).first()[0], *cuts[1:]]
    candidate = fit & (F.col("score") >= cuts[0])
    bounds = [-math.inf, *sorted({float(c) for c in cuts[1:]}), math.inf]
    found = scored.filter(candidate).withColumn("as_double", F.col("score").cast("double"))
    found = Bucketizer(splits=bounds, inputCol="as_double", outputCol="run").transform(found) if len(bounds) > 2 else found.withColumn("run", F.lit(0.0))
    names = ["k", "n_words", "n_features", "weight", "score", "run"]
    groups = S.written(found.groupBy(*names).agg(F.count("*").alias("n")), "candidates")
    # at most RUNS rows
    above = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.groupBy("run").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).withColumn("offset", F.coalesce(F.sum("rows").over(above), F.lit(0)))
    order = Window.partitionBy("run").orderBy(F.desc("score"), F.asc_nulls_last("k"), "n_features", "n_words", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(F.broadcast(offsets), "run").withColumn("start", F.col("offset") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {EQUAL_ROWS}")))
    placed = placed.select("*", block.alias("block"))
    if offsets.agg(F.max("most")).first()[0] > EQUAL_ROWS:
        placed = placed.repartition("run", "k", "block")
    each = F.sequence(F.col("block") * EQUAL_ROWS, F.least(F.col("n"), (F.col("block") + 1) * EQUAL_ROWS) - 1)
    placed = placed.select(*names[:-1], "start", F.explode(each).alias("i")).withColumn("rank", F.col("start") + F.col("i") + 1)
    drawn = placed.select(*names[:-1], F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return no_rank.filter(~candidate).unionByName(drawn)


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_words: int = 3, buckets: int = 10_000, seed: int = 42, percent: int = 5, min_words: int = 20) -> DataFrame:
    """Draws documents without replacement so that their n-grams come to look like the target's.

    A window of one to max_words words falls into bucket crc32 modulo `buckets`. A bucket's gain is the log ratio of its
    smoothed shares in target and docs; a document's weight is the sum over its windows, its score the weight plus seeded
    Gumbel noise by id, and the highest scores are drawn.

    Returns id, n_words, n_features, weight, score and rank (null: not drawn), one row per input row. Null and empty texts
    have no words and weight 0; texts below min_words are never drawn. A null id has the noise of an empty one and loses
    ties; repeated rows count and are drawn each by itself. An empty target gives every bucket the share 1 / buckets.
    Whole texts are split once; their packed buckets are kept, about the size of the input. The driver sees the two
    histograms, of `buckets` numbers each.
    """
    rows = S.written(features(docs, id_col, text_col, max_words, buckets), "features")
    gain = gains(histogram(rows, buckets), histogram(features(target, None, target_text_col, max_words, buckets), buckets))
    weighed = rows.mapInArrow(_weights(gain), "k long, n_words long, n_features long, weight long")
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = S.written(weighed.withColumn("score", F.col("weight") + noise), "scored")
    S.discard(rows)
    return ranked(scored, percent, min_words).withColumnRenamed("k", id_col)
