"""Suffix-array dedup by distributed prefix doubling.

No rank is sorted: ranks are hashes, and positions are compared by grouping equal ones, as only repeats are asked
for. Suffixes are looked at from content-defined positions only: the smallest 16-byte hash of every 64 positions. Equal texts
pick equal positions, so the text between two of them is a phrase, and a suffix is a sequence of phrases. Prefix
doubling ranks two phrases (one, if a window need not hold two), then pairs of ranks at offsets of two phrases, four and
so on, dropping a position as soon as its rank is unique, up to the longest prefix that every repeat of the threshold length must hold. The
byte windows that start before a position left over are then counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T

GRAM, SPREAD = 16, 64
FLUSH = 1 << 20
_PHRASES = "bucket int, n int, keys binary, many binary, one int, ids binary, nos binary, sure int, skeys binary, sids binary, snos binary"
_CUT = "u long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, n_repeated long"


@dataclass
class Positions:
    """Content-defined positions of the texts of one slice."""

    data: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray  #: of the bytes, as `T.prefix` has them
    owner: np.ndarray  #: by byte: the position that the windows starting there belong to
    at: np.ndarray  #: all positions, rising
    text: np.ndarray  #: text of each
    number: np.ndarray  #: number of each within its text


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours, from those of half as many."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (w - k)], v[w - k :]) if k < w else v


def positions(texts: pa.Array) -> Positions:
    data, off = T.flat(texts)
    starts = T.inside_text(off, SPREAD + GRAM - 1)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Positions(data, off, np.zeros(1, np.uint64), none, none, none, none)
    sums = T.prefix(T.BYTE_VALUES[data])
    h = T.windows_of(sums, GRAM)
    low = np.uint64(0xFFFFFFFF)
    owner = (_window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), SPREAD) & low).astype(np.int64)
    picked = np.zeros(len(data), bool)
    picked[owner[starts]] = True
    at = np.flatnonzero(picked)
    text = np.searchsorted(off, at, "right") - 1
    return Positions(data, off, sums, owner, at, text, np.arange(len(at)) - np.searchsorted(at, off[:-1])[text])


def _send_phrases(length: int, buckets: int, phrases: int = 1):
    """Sends each distinct run of so many phrases of a task once, as one phrase; places of phrases the task holds twice are known to repeat and are
    spread over all buckets, so that a common phrase makes no bucket large."""

    def flush(keys, ids, nos) -> pa.RecordBatch:
        h, k, no = np.concatenate(keys), np.concatenate(ids), np.concatenate(nos)
        order = np.argsort(h, kind="stable")
        h, k, no = h[order], k[order], no[order]
        u, back, c = np.unique(h, return_inverse=True, return_counts=True)
        sure = c[back] > 1
        sh, sk, sno = h[sure], k[sure], no[sure]
        to = (T.mix(sk.view(np.uint64) + sno.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        sh, sk, sno, to = sh[order], sk[order], sno[order], to[order]
        edge = np.searchsorted(to, np.arange(buckets + 1))
        own = {b: (lo, hi) for b, lo, hi in S.bucket_bounds(u, buckets)}
        hb, kb, nb = h[~sure], k[~sure], no[~sure]
        single = {b: (lo, hi) for b, lo, hi in S.bucket_bounds(hb, buckets)} if len(hb) else {}
        rows = []
        for b in range(buckets):
            lo, hi = own.get(b, (0, 0))
            x, y = single.get(b, (0, 0))
            s, e = edge[b], edge[b + 1]
            if hi > lo or e > s:
                rows.append((b, hi - lo, S.pack_sorted(u[lo:hi]), np.packbits(c[lo:hi] > 1).tobytes(), y - x, S.pack(kb[x:y]), S.pack(nb[x:y]), int(e - s), S.pack(sh[s:e]), S.pack(sk[s:e]), S.pack(sno[s:e])))
        i, x = pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (i, i, x, x, i, x, x, i, x, x, x), strict=True)], names=[p.split()[0] for p in _PHRASES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], []), 0
        for batch in batches:
            k = batch.column("u").to_numpy()
            for lo, hi in T.slices(batch.column("text"), T.SMALL_SLICE_BYTES):
                p = positions(batch.column("text").slice(lo, hi - lo))
                if len(p.at) <= phrases:
                    continue
                pair = np.flatnonzero((p.text[phrases:] == p.text[:-phrases]) & (np.diff(p.offsets)[p.text[:-phrases]] >= length))
                h = T.spans_of(p.sums, p.at[pair], p.at[pair + phrases])
                for x, y in zip(held, (h, k[lo:hi][p.text[pair]], p.number[pair].astype(np.int32)), strict=True):
                    x.append(y)
                n += len(h)
                if n >= FLUSH:
                    yield from S.in_pieces(flush(*held))
                    held, n = ([], [], []), 0
        if n:
            yield from S.in_pieces(flush(*held))

    return run


def _repeated_phrases(table: pa.Table) -> pa.Table:
    col = {n: table[n].to_pylist() for n in table.column_names}
    keys = [S.unpack_sorted(b, n) for b, n in zip(col["keys"], col["n"], strict=True)]
    many = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(col["many"], col["n"], strict=True)]
    s = np.sort(np.concatenate(keys))
    twice = np.union1d(s[1:][s[1:] == s[:-1]], np.concatenate([k[m] for k, m in zip(keys, many, strict=True)]))
    ks, nos, hs = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
    for i in range(len(keys)):
        h = keys[i][~many[i]]
        if len(h) and len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
            ks.append(S.unpack(col["ids"][i], col["one"][i], np.int64)[hit])
            nos.append(S.unpack(col["nos"][i], col["one"][i], np.int32)[hit])
            hs.append(h[hit])
        if col["sure"][i]:
            ks.append(S.unpack(col["sids"][i], col["sure"][i], np.int64))
            nos.append(S.unpack(col["snos"][i], col["sure"][i], np.int32))
            hs.append(S.unpack(col["skeys"][i], col["sure"][i]))
    return pa.table([np.concatenate(ks), np.concatenate(nos), np.concatenate(hs).view(np.int64)], names=["u", "m", "r"])


def doubled(ranks: DataFrame, offset: int) -> DataFrame:
    """Ranks (u, m, r) of twice as long prefixes: pairs of ranks `offset` phrases apart that occur twice or more. Takes
    the place of the written table `ranks`."""
    later = ranks.select("u", (F.col("m") - offset).alias("m"), F.col("r").alias("r2"))
    # written, so that the join below has exchanges of its own, in which a very frequent pair can be split
    pairs = S.written(ranks.join(later, ["u", "m"]), "pairs")
    again = S.written(pairs.groupBy("r", "r2").count().filter("count > 1").select("r", "r2"), "again")
    out = S.written(pairs.join(again, ["r", "r2"], "left_semi").select("u", "m", F.xxhash64("r", "r2").alias("r")), "ranks")
    S.discard(ranks, pairs, again)
    return out


def _candidates(table: pa.Table, lengths: list[int]):
    """By slice, and for each length by its column of hits: where the windows start that may repeat, and their hashes."""
    table = S.sorted_rows(table, "u")
    texts = S.one_array(table["text"])
    for lo, hi in T.slices(texts, T.SMALL_SLICE_BYTES):
        p = positions(texts.slice(lo, hi - lo))
        begin = np.searchsorted(p.at, p.offsets)
        found = []
        for length in lengths:
            live = np.zeros(len(p.data) + 1, bool)
            own = S.one_array(table[f"hits_{length}"].slice(lo, hi - lo))
            text = np.repeat(np.arange(hi - lo), np.asarray(own.value_lengths()))
            number = begin[text] + np.asarray(own.flatten())
            number = number[number < begin[text + 1]]
            live[p.at[number]] = True
            at = T.inside_text(p.offsets, length)
            at = at[live[p.owner[at]]] if len(at) else at
            # windows of one length never meet those of another
            h = T.spans_of(p.sums, at, at + length) ^ T.mix(np.array([length], np.uint64))
            found.append((length, at, h))
        yield lo, hi, p, found


def _hashes(slices) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(h for *_, found in slices for *_, h in found)])


def _ask(lengths: list[int], buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return S.requests(key[0].as_py(), _hashes(_candidates(table, lengths)), buckets)

    return run


def _remove(lengths: list[int], with_bytes: bool, with_text: bool):
    """The first length is removed, the last one's bytes are counted."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        table = S.sorted_rows(table, "u")
        u = table["u"].to_pylist()
        slices = [(lo, hi, p.data, p.offsets, found) for lo, hi, p, found in _candidates(table, lengths)]
        twice = S.answered(answers, _hashes(slices))
        out, used = [], 0
        for lo, hi, data, off, found in slices:
            keeps = []
            for length, at, h in found:
                mine = at[twice[used : used + len(h)]]
                used += len(h)
                step = np.zeros(len(data) + 1, np.int32)
                step[mine] += 1
                step[mine + length] -= 1
                keeps.append(np.cumsum(step[:-1], dtype=np.int32) == 0)
            keep, other = keeps[0], keeps[-1]
            for d in range(hi - lo):
                a, b = off[d], off[d + 1]
                left = keep[a:b]
                kept = data[a:b][left].tobytes()
                spans = int(np.count_nonzero(np.diff(left.astype(np.int8), prepend=1) == -1))
                repeated = int(b - a) - int(np.count_nonzero(other[a:b]))
                out.append((u[lo + d], int(b - a) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, kept.decode("utf-8", "ignore") if with_text else None, repeated))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["u", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "n_repeated"])

    return run


def _phrases_inside(length: int) -> int:
    """Phrases after a window's position that its bytes alone decide. The position is among the first SPREAD bytes; the
    next position after any is at most SPREAD bytes on, and SPREAD + GRAM - 1 bytes from the one before decide it."""
    return (length - (SPREAD + GRAM - 1)) // SPREAD


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_bytes: bool = True, with_text: bool = True, also: int | None = None) -> DataFrame:
    """Removes every byte covered by a `length`-byte string that also starts anywhere else in the texts (UTF-8).

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left; null where
    nothing was removed, and always unless with_bytes), kept_text (the same as text, without bytes of characters cut in two; always null unless with_text) and text_sha256 (of the input), one row per input row. Null or empty texts have no bytes. Exact copies of `length` bytes or
    more lose everything, the first as well; one copy stands for all while other texts are judged. Repeated ids and
    rows are texts of their own. A null id stays null. Texts below `length` bytes keep all, even if repeated.

    With `also`, a smaller length, a last column n_repeated counts the bytes covered by an `also`-byte string that also
    starts anywhere else. They are counted alone: what is removed stays the same.
    """
    if length < 3 * SPREAD:
        raise ValueError(f"length must be at least {3 * SPREAD}")
    if also is not None and not 3 * SPREAD <= also < length:
        raise ValueError(f"also must be at least {3 * SPREAD}, and below length")
    lengths = [length] if also is None else [length, also]
    texts = S.texts_of(docs, id_col, text_col)
    total = S.total_bytes(texts)
    full = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = S.written(texts.select("k", "u", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), full.alias("sha")), "texts")
    copies = S.written(rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("u").alias("first")).filter("copies > 1"), "copies")
    members = S.written(rows.join(copies, "sha").groupBy("u").agg(F.min("first").alias("first"), F.count("*").alias("rows")), "members")
    equal_rows = not members.filter("rows > 1").isEmpty()
    # one of all equal texts; only texts that may have equals are shuffled for it
    doubtful = S.likely_in(texts, "u", members.select("u")).dropDuplicates(["u"])
    once = S.likely_in(texts, "u", members.select("u"), others=True).unionByName(doubtful.join(members.filter("u <> first"), "u", "left_anti"))
    # a first rank of two phrases, where each window holds as many, spares the largest round
    offset = min(2, _phrases_inside(lengths[-1]))
    sent = once.select("u", "text").mapInArrow(_send_phrases(lengths[-1], S.parts(total // 32, S.BUCKET_KEYS // 2), offset), _PHRASES)
    ranks = S.written(sent.groupBy("bucket").applyInArrow(_repeated_phrases, "u long, m int, r long"), "ranks")
    hits = []
    for each in reversed(lengths):
        while 2 * offset <= _phrases_inside(each):
            ranks = doubled(ranks, offset)
            offset *= 2
        hits.append(S.written(ranks.groupBy("u").agg(F.collect_set("m").alias(f"hits_{each}")), "hits"))
    S.discard(ranks)
    # half of a common chunk: where most windows repeat, a byte of it and of each length costs its task up to 80 bytes
    chunks, buckets = S.parts(total, S.CHUNK_BYTES // (2 * len(lengths))), S.parts(total // (5 - len(lengths)), S.BUCKET_KEYS)
    # what repeats at the larger length does so at the smaller
    both = hits[0] if also is None else hits[0].join(hits[1], "u", "left").withColumn(f"hits_{length}", F.coalesce(f"hits_{length}", F.array().cast("array<int>")))
    near = S.likely_in(texts, "u", hits[0].select("u"))
    if equal_rows:  # of which one stands for all
        near = near.dropDuplicates(["u"])
    near = near.join(both, "u").select(F.pmod("u", F.lit(chunks)).alias("chunk"), "u", "text", *(f"hits_{x}" for x in lengths))
    near = S.written(near, "repeating")
    S.discard(*hits)
    answers = S.replies(near.groupBy("chunk").applyInArrow(_ask(lengths, buckets), S.REQUEST))
    cut = near.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(lengths, with_bytes, with_text), _CUT)
    out = rows.join(copies.select("sha", "copies"), "sha", "left").join(cut, "u", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    kept = F.when(gone, F.lit(b"")).otherwise(F.when(F.col("n_removed") > 0, F.col("kept")))
    return out.select(
        S.id_back().alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        kept.alias("kept"),
        F.when(gone, F.lit("")).otherwise(F.when(F.col("n_removed") > 0, F.col("kept_text"))).alias("kept_text"),
        F.col("sha").alias("text_sha256"),
        *([] if also is None else [F.when(F.col("copies").isNotNull() & (F.col("n_bytes") >= also), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).alias("n_repeated")]),
    )
