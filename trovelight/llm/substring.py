"""Substring dedup over words by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T

#: Rolling windows that a map task gathers before it sends them.
FLUSH = 2 << 20
_PROBE = "bucket int, n int, keys binary, many binary, b int, bkeys binary, ids binary, nos binary, sure int, sids binary, snos binary"
_RESULT = "k long, u long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _probes(block: int, buckets: int):
    """Sends every rolling block-sized window once a task and bucket, as 32 bits below the bucket's, and each aligned
    block with its place. Blocks whose words the task holds twice are hit for sure; their places are spread over all
    buckets, so that a common passage makes no bucket large."""

    def flush(keys, blocks, ids, nos) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(keys), return_counts=True)
        h, i, no = np.concatenate(blocks), np.concatenate(ids), np.concatenate(nos)
        sure = c[np.searchsorted(u, h)] > 1
        si, sno = i[sure], no[sure]
        to = (T.mix(si.view(np.uint64) + sno.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        si, sno, edge = si[order], sno[order], np.searchsorted(to[order], np.arange(buckets + 1))
        h, i, no = h[~sure], i[~sure], no[~sure]
        order = np.argsort(h, kind="stable")
        h, i, no = h[order], i[order], no[order]
        at = {b: (lo, hi) for b, lo, hi in S.bucket_bounds(h, buckets)} if len(h) else {}
        own = {b: (lo, hi) for b, lo, hi in S.bucket_bounds(u, buckets)}
        rows = []
        for b in range(buckets):
            (lo, hi), (x, y), (s, e) = own.get(b, (0, 0)), at.get(b, (0, 0)), edge[b : b + 2]
            if hi > lo or e > s:
                rows.append((b, hi - lo, u[lo:hi].astype(np.uint32).tobytes(), np.packbits(c[lo:hi] > 1).tobytes(), y - x, h[x:y].astype(np.uint32).tobytes(), S.pack(i[x:y]), S.pack(no[x:y]), int(e - s), S.pack(si[s:e]), S.pack(sno[s:e])))
        n, x = pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (n, n, x, x, n, x, x, x, n, x, x), strict=True)], names=[p.split()[0] for p in _PROBE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], []), 0
        for batch in batches:
            texts, k = batch.column("text"), np.asarray(batch.column("u"))
            for lo, hi in T.slices(texts):
                w = T.words(texts.slice(lo, hi - lo))
                at = T.inside_text(w.first, block)
                if not len(at):
                    continue
                h = T.rolling(w.hash, block)[at]
                doc = w.text_of[at]
                place = at - w.first[doc]
                own = place % block == 0
                for x, y in zip(held, (h, h[own], k[lo:hi][doc[own]], (place[own] // block).astype(np.int32)), strict=True):
                    x.append(y)
                n += len(h)
                if n >= FLUSH:
                    yield flush(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield flush(*held)

    return run


def _hit_blocks(table: pa.Table) -> pa.Table:
    """Of one bucket: the blocks whose words some other rolling window has as well."""
    col = {n: table[n].to_pylist() for n in table.column_names}
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in col["keys"]])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(col["many"], col["n"], strict=True)]).astype(bool)
    s = np.sort(keys)
    twice = np.union1d(s[1:][s[1:] == s[:-1]], keys[many])
    have = [i for i, b in enumerate(col["b"]) if b]
    ids, nos = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for i in have:
        mine = np.frombuffer(col["bkeys"][i], np.uint32)
        hit = twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine if len(twice) else np.zeros(len(mine), bool)
        ids.append(S.unpack(col["ids"][i], col["b"][i], np.int64)[hit])
        nos.append(S.unpack(col["nos"][i], col["b"][i], np.int32)[hit])
    for i in (i for i, n in enumerate(col["sure"]) if n):
        ids.append(S.unpack(col["sids"][i], col["sure"][i], np.int64))
        nos.append(S.unpack(col["snos"][i], col["sure"][i], np.int32))
    return pa.table([np.concatenate(ids), np.concatenate(nos)], names=["u", "no"])


def _candidates(table: pa.Table, window: int, block: int):
    """Slices of a chunk, each with its words and the starts and hashes of windows whose aligned block was hit."""
    table = S.sorted_rows(table, "k", "u")
    texts, hits = S.one_array(table["text"]), table["hits"]
    for lo, hi in T.slices(texts):
        w = T.words(texts.slice(lo, hi - lo))
        per = np.diff(w.first) // block + 1
        off = np.concatenate([[0], np.cumsum(per)])
        hit = np.zeros(off[-1], bool)
        own = S.one_array(hits.slice(lo, hi - lo))
        text = np.repeat(np.arange(hi - lo), np.asarray(own.value_lengths()))
        hit[off[text] + np.asarray(own.flatten())] = True
        at = T.inside_text(w.first, window)
        if len(at):
            doc = w.text_of[at]
            inner = -(-(at - w.first[doc]) // block)
            at = at[hit[off[doc] + inner]]
        yield lo, hi, w, at, T.rolling(w.hash, window)[at] if len(at) else np.empty(0, np.uint64)


def _ask(window: int, block: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return S.requests(key[0].as_py(), np.concatenate([np.empty(0, np.uint64), *(h for *_, h in _candidates(table, window, block))]), buckets)

    return run


def _rows(out: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=["k", "u", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"])


def _remove(window: int, block: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        table = S.sorted_rows(table, "k", "u")
        k, u = table["k"].to_numpy(), table["u"].to_numpy()
        found = list(_candidates(table, window, block))
        twice = S.answered(answers, np.concatenate([np.empty(0, np.uint64), *(h for *_, h in found)]))
        out, used = [], 0
        for lo, hi, w, at, h in found:
            mine = at[twice[used : used + len(h)]]
            used += len(h)
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, mine, 1)
            np.add.at(step, mine + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            raw = w.data.tobytes()
            for d in range(hi - lo):
                a, b = w.first[d], w.first[d + 1]
                g = gone[a:b]
                keep = np.flatnonzero(~g) + a
                kept = b" ".join([raw[x:y] for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                spans = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1))
                out.append((int(k[lo + d]), int(u[lo + d]), int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return _rows(out)

    return run


def _untouched(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, u, text in zip(*(batch.column(x).to_pylist() for x in ("k", "u", "text")), strict=True):
                found = (text or "").encode().split()
                kept = b" ".join(found)
                out.append((k, u, len(found), 0, 0, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield from _rows(out).to_batches()

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = True) -> DataFrame:
    """Removes every word that lies in a `window`-word sequence which also starts anywhere else.

    Non-overlapping blocks of (window + 1) // 2 words are the index: every window holds at least one whole block.
    All rolling block-sized windows probe it; only windows around a block that was hit go on, and their full word
    sequences are counted, so that runs of them are the maximal exact repeats.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (null unless with_text), one row per input row.
    Null or empty text: no words, the hash of nothing. Repeated ids and rows are texts of their own and match each
    other. A null id stays null. Texts below `window` words keep all. Other columns are not read.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    block = (window + 1) // 2
    texts = S.texts_of(docs, id_col, text_col)
    total = S.total_bytes(texts)
    buckets, chunks = S.parts(total // 6, S.BUCKET_KEYS), S.parts(total, S.CHUNK_BYTES)
    hits = texts.mapInArrow(_probes(block, buckets), _PROBE).groupBy("bucket").applyInArrow(_hit_blocks, "u long, no int")
    hits = S.written(hits.groupBy("u").agg(F.collect_set("no").alias("hits")), "anchors")
    # written, so that equal rows can be dealt to chunks by a number that is not kept
    near = S.likely_in(texts, "u", hits.select("u")).join(hits, "u").withColumn("chunk", F.pmod(F.xxhash64("u", F.monotonically_increasing_id()), F.lit(chunks)))
    near = S.written(near.select("chunk", "k", "u", "text", "hits"), "anchored")
    answers = S.replies(near.groupBy("chunk").applyInArrow(_ask(window, block, buckets), S.REQUEST))
    cut = near.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(window, block, with_text), _RESULT)
    rest = texts.mapInArrow(_untouched(with_text), _RESULT).join(hits.select("u"), "u", "left_anti")
    return cut.unionByName(rest).select(S.id_back().alias(id_col), "n_words", "n_removed", "n_spans", "kept_sha256", "kept")
