"""Language-model scoring: a Katz backoff bigram model over all training texts.

Texts are dealt into chunks. A chunk asks for the counts of its distinct words, then sends its distinct bigrams, with
these counts and the places where they stand, to the bucket of their first word; very frequent first words are spread
over all buckets by the second. A bucket therefore knows everything about its bigrams, and answers with sums per
text, in which the discounts, known only at the end, are still open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T
from trovelight.llm.langid import id_remainder

#: Counts up to here are Good-Turing discounted; larger ones lose ABOVE, so that every context can back off.
K, ABOVE = 5, 0.1
CHUNK_BYTES = 10 << 20
BUCKET_BIGRAMS = 5 << 18
START, END = (x for x in T.mix(np.array([1009, 1013], np.uint64)))
_WORDS = "chunk long, bucket int, n int, keys binary, counts binary, stats array<long>"
_BIGRAMS = "chunk long, bucket int, kind int, n int, m int, u binary, w binary, cw binary, cu binary, ct binary, occ binary, doc binary"
_SUMS = "chunk long, kind int, n int, m int, v int, known binary, seen binary, doc binary, u binary, table binary, stats array<double>"
_SCORES = "k long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz discount ratio of counts 1..K from the numbers of types with counts 1..K+1. Where Good-Turing is undefined
    or leaves (0, 1), half a count is taken off."""
    out = np.empty(K)
    last = (K + 1) * n[K] / n[0] if n[0] else 0.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - last) / (1 - last) if n[r - 1] and n[r] and last < 1 else -1.0
        out[r - 1] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    """N, V and the discounts of word counts; what they take off is the share of unknown words."""

    tokens: int
    types: int
    discount: tuple[float, ...]
    unknown: float

    @classmethod
    def of(cls, tokens: int, types: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        freed = sum((1 - d[r]) * (r + 1) * n[r] for r in range(K)) + ABOVE * (types - n[:K].sum())
        return cls(tokens, types, tuple(d), freed / tokens if tokens else 1.0)

    def share(self, c: np.ndarray) -> np.ndarray:
        d = np.concatenate([[0.0], self.discount])
        return np.where(c == 0, self.unknown, np.where(c <= K, d[np.minimum(c, K)] * c, c - ABOVE) / max(self.tokens, 1))


@dataclass
class Tokens:
    word: np.ndarray  #: words of each text, then END
    before: np.ndarray  #: START, then the words
    text: np.ndarray
    texts: int


def _tokens(table: pa.Table) -> Tokens:
    texts = S.one_array(table["text"])
    word, before, text = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    for lo, hi in T.slices(texts):
        w = T.words(texts.slice(lo, hi - lo), lower=True)
        docs = hi - lo
        at = np.arange(len(w.start)) + w.text_of
        ends = w.first[1:] + np.arange(docs)
        a, b = np.full(len(w.start) + docs, END, np.uint64), np.full(len(w.start) + docs, START, np.uint64)
        a[at] = w.hash
        b[at + 1] = w.hash
        word.append(a)
        before.append(b)
        text.append(np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(np.concatenate([[-1], ends]))))
    return Tokens(np.concatenate(word), np.concatenate(before), np.concatenate(text), len(texts))


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _ask_words(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = S.sorted_rows(table, "k", "text")
        t = _tokens(table)
        taught = ~table["held_out"].to_numpy()
        u, back = np.unique(t.word, return_inverse=True)
        c = np.bincount(back, weights=taught[t.text], minlength=len(u)).astype(np.int64)
        return _table([(key[0].as_py(), b, hi - lo, S.pack_sorted(u[lo:hi]), S.pack(c[lo:hi]), None) for b, lo, hi in S.bucket_bounds(u, buckets)], _WORDS)

    return run


def _count_words(table: pa.Table) -> pa.Table:
    ns = table["n"].to_pylist()
    keys = np.concatenate([S.unpack_sorted(b, n) for b, n in zip(table["keys"].to_pylist(), ns, strict=True)])
    counts = np.concatenate([S.unpack(b, n, np.int64) for b, n in zip(table["counts"].to_pylist(), ns, strict=True)])
    u, back = np.unique(keys, return_inverse=True)
    c = np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)
    bucket, edge = table["bucket"][0].as_py(), np.concatenate([[0], np.cumsum(ns)])
    rows = [(chunk, bucket, n, None, S.pack(c[back[x : x + n]]), None) for chunk, n, x in zip(table["chunk"].to_pylist(), ns, edge, strict=False)]
    rows.append((-1, bucket, 0, None, None, [int(c.sum()), int((c > 0).sum()), *(int((c == r).sum()) for r in range(1, K + 2))]))
    return _table(rows, _WORDS)


def _send_bigrams(buckets: int, words: Unigrams, hot: int):
    def entries(chunk: int, pick: np.ndarray, bucket: np.ndarray, u: np.ndarray, w: np.ndarray, cu: np.ndarray, cw: np.ndarray, t: Tokens, taught: np.ndarray) -> list[tuple]:
        if not len(pick):
            return []
        order = pick[np.lexsort((w[pick], u[pick], bucket[pick]))]
        b, x, y = bucket[order], u[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        occ = np.diff(np.append(new, len(order)))
        ct = np.add.reduceat(taught[t.text[order]].astype(np.int64), new)
        edge = np.searchsorted(b[new], np.arange(buckets + 1))
        rows = []
        for i in np.flatnonzero(np.diff(edge)):
            lo, hi = edge[i], edge[i + 1]
            one = new[lo:hi]
            end = new[hi] if hi < len(new) else len(order)
            rows.append((chunk, int(i), 0, int(hi - lo), int(end - one[0]), S.pack_sorted(x[one]), S.pack(y[one]), S.pack(cw[order[one]]), S.pack(cu[order[one]]), S.pack(ct[lo:hi]), S.pack(occ[lo:hi]), S.pack(t.text[order[one[0] : end]])))
        return rows

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _BIGRAMS)
        table = S.sorted_rows(table, "k", "text")
        t = _tokens(table)
        taught = ~table["held_out"].to_numpy()
        rows = sorted(zip(answers["bucket"].to_pylist(), answers["n"].to_pylist(), answers["counts"].to_pylist(), strict=True), key=lambda r: r[0])
        c = np.concatenate([S.unpack(x, n, np.int64) for _, n, x in rows])
        u, back = np.unique(t.word, return_inverse=True)
        if len(u) != len(c):
            raise ValueError("a chunk changed between asking and being answered")
        cw = c[back]
        first = np.concatenate([[True], t.text[1:] != t.text[:-1]])
        cu = np.where(first, c[np.searchsorted(u, END)], np.concatenate([[0], cw[:-1]]))
        base = np.log10((cw + 0.1) / (words.tokens + 0.1 * (words.types + 1)))
        info = np.stack([np.bincount(t.text, minlength=t.texts), np.bincount(t.text, weights=cw > 0, minlength=t.texts), np.bincount(t.text, weights=base, minlength=t.texts)]).astype(np.float64)
        chunk = key[0].as_py()
        out = [(chunk, chunk % buckets, 1, t.texts, 0, S.pack(table["k"].to_numpy()), np.packbits(taught).tobytes(), S.pack(info.ravel()), None, None, None, None)]
        hu, hw = T.mix(t.before), T.mix(t.word)
        spread = cu > hot
        bucket = S.bucket_of(np.where(spread, T.mix(hu ^ (hw << np.uint64(1))), hu), buckets).astype(np.int64)
        uid, wid = hu >> np.uint64(24), hw >> np.uint64(24)
        for pick in (np.flatnonzero(~spread), np.flatnonzero(spread)):
            out += entries(chunk, pick, bucket, uid, wid, cu, cw, t, taught)
        return _table(out, _BIGRAMS)

    return run


def _sum_bigrams(words: Unigrams, hot: int):
    """Per chunk: sums of log probabilities by text without discounts, how often counts 1..K were met, and the places
    that back off with what their context's weight is made of."""

    def run(table: pa.Table) -> pa.Table:
        col = {n: table[n].to_pylist() for n in table.column_names}
        out = [(col["chunk"][i], 1, col["n"][i], 0, 0, col["u"][i], col["w"][i], col["cw"][i], None, None, None) for i in range(len(col["kind"])) if col["kind"][i] == 1]
        have = [i for i in range(len(col["kind"])) if col["kind"][i] == 0]
        if not have:
            return _table(out, _SUMS)
        get = lambda name, dtype=np.int64: np.concatenate([S.unpack(col[name][i], col["n"][i], dtype) for i in have])
        u, w = np.concatenate([S.unpack_sorted(col["u"][i], col["n"][i]) for i in have]), get("w", np.uint64)
        cw, cu, ct, occ = get("cw"), get("cu"), get("ct"), get("occ")
        order = np.lexsort((w, u))
        new = np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])])
        pair = np.empty(len(u), np.int64)
        pair[order] = np.cumsum(new) - 1
        r_pair = np.bincount(pair, weights=ct).astype(np.int64)
        one = order[new]
        r = r_pair[pair]
        # what the backoff weight of each context is made of
        new_u = np.concatenate([[True], u[one][1:] != u[one][:-1]])
        ctx_of_pair = np.cumsum(new_u) - 1
        n_ctx = int(new_u.sum())
        seen = r_pair > 0
        parts = np.zeros((n_ctx, K + 3))
        for x in range(1, K + 1):
            parts[:, x - 1] = np.bincount(ctx_of_pair, weights=r_pair == x, minlength=n_ctx)
        parts[:, K] = np.bincount(ctx_of_pair, weights=np.where(r_pair > K, r_pair - ABOVE, 0), minlength=n_ctx)
        parts[:, K + 1] = np.bincount(ctx_of_pair, weights=np.where(seen, words.share(cw[one]), 0), minlength=n_ctx)
        parts[:, K + 2] = cu[one][new_u]
        ctx = ctx_of_pair[pair]
        names = u[one][new_u]
        is_hot = parts[:, K + 2] > hot
        log_seen = np.log10(np.where(r > K, r - ABOVE, np.maximum(r, 1))) - np.log10(np.maximum(cu, 1))
        log_back = np.log10(words.share(cw))
        edge = np.concatenate([[0], np.cumsum([col["n"][i] for i in have])])
        for j, i in enumerate(have):
            lo, hi = edge[j], edge[j + 1]
            doc = S.unpack(col["doc"][i], col["m"][i], np.int32)
            e = np.repeat(np.arange(lo, hi), occ[lo:hi])
            top = int(doc.max()) + 1
            known = np.bincount(doc, weights=np.where(r[e] > 0, log_seen[e], log_back[e]), minlength=top)
            met = np.stack([np.bincount(doc[r[e] == x], minlength=top) for x in range(1, K + 1)]).astype(np.int32)
            back = (r[e] == 0) & (cu[e] > 0)
            v, which = np.unique(ctx[e[back]], return_inverse=True)
            table_rows = np.concatenate([parts[v], np.where(is_hot[v], names[v], 0).astype(np.int64).view(np.float64)[:, None]], axis=1)
            out.append((col["chunk"][i], 0, top, int(back.sum()), len(v), S.pack(known), S.pack(met.ravel()), S.pack(doc[back]), S.pack(which.astype(np.int32)), S.pack(np.ascontiguousarray(table_rows.T).ravel()), None))
        out.append((-1, 2, 0, 0, 0, None, None, None, None, None, [float((r_pair == x).sum()) for x in range(1, K + 2)]))
        out += [(int(names[x]), 3, 0, 0, 0, None, None, None, None, None, [float(y) for y in parts[x]]) for x in np.flatnonzero(is_hot)]
        return _table(out, _SUMS)

    return run


def backoff_weights(parts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What seen followers leave of a context's probability, over what they leave of the unigrams'."""
    used = (parts[:, :K] @ (d * np.arange(1, K + 1)) + parts[:, K]) / np.maximum(parts[:, K + 2], 1)
    return np.maximum(1 - used, 1e-12) / np.maximum(1 - parts[:, K + 1], 1e-12)


def _finish(d: np.ndarray, hot_weights: dict[int, float]):
    logs = np.log10(d)

    def run(table: pa.Table) -> pa.Table:
        col = {n: table[n].to_pylist() for n in table.column_names}
        at = col["kind"].index(1)
        n = col["n"][at]
        k, taught = S.unpack(col["known"][at], n, np.int64), np.unpackbits(np.frombuffer(col["seen"][at], np.uint8), count=n).astype(bool)
        tokens, known, base = S.unpack(col["doc"][at], 3 * n, np.float64).reshape(3, n)
        score = np.zeros(n)
        # buckets in a fixed order, as sums of floats depend on it
        for i in sorted((i for i in range(len(col["kind"])) if col["kind"][i] == 0), key=lambda i: (col["known"][i], col["doc"][i])):
            top, m, v = col["n"][i], col["m"][i], col["v"][i]
            score[:top] += S.unpack(col["known"][i], top, np.float64) + logs @ S.unpack(col["seen"][i], K * top, np.int32).reshape(K, top)
            if m:
                parts = S.unpack(col["table"][i], v * (K + 4), np.float64).reshape(K + 4, v).T
                weight = backoff_weights(parts[:, : K + 3], d)
                name = np.ascontiguousarray(parts[:, K + 3]).view(np.int64)
                for x in np.flatnonzero(name):
                    weight[x] = hot_weights[int(name[x])]
                score[:top] += np.bincount(S.unpack(col["doc"][i], m, np.int32), weights=np.log10(weight)[S.unpack(col["u"][i], m, np.int32)], minlength=top)
        return _table(list(zip(k.tolist(), (~taught).tolist(), tokens.astype(int).tolist(), known.astype(int).tolist(), base.tolist(), score.tolist(), strict=True)), _SCORES)

    return run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0) -> DataFrame:
    """Log10 probability of each whole text under a Katz backoff bigram model of the texts outside the held-out fold.

    Tokens are words (runs of non-space bytes, A-Z lower-cased) and one end for each text. Seen bigrams have
    discounted relative frequency, others their context's backoff weight times the word's own discounted frequency;
    unknown words share what the word discounts free. Over all words, one unknown and the end, the probabilities after
    any context sum to 1. Words and contexts are told apart by 40 bits beside the bucket's.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score, one row per
    input row. Null text counts as empty: one token, the end. Repeated rows each teach and return. Without training
    texts every token is unknown, with probability 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(S.NO_ID)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (id_remainder(id_col, folds) == held_out).alias("held_out"))
    total = S.total_bytes(rows)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("k", "text"), F.lit(S.parts(total, CHUNK_BYTES))))
    word_buckets, buckets = S.parts(total // 24, S.BUCKET_KEYS // 2), S.parts(total // 10, BUCKET_BIGRAMS)
    counted = S.written(rows.groupBy("chunk").applyInArrow(_ask_words(word_buckets), _WORDS).groupBy("bucket").applyInArrow(_count_words, _WORDS), "words")
    stats = counted.filter("chunk = -1").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(K + 3))).first()
    words = Unigrams.of(stats[0], stats[1], np.array(stats[2:], np.float64))
    hot = max(1000, words.tokens // (4 * buckets))
    sent = rows.groupBy("chunk").cogroup(counted.filter("chunk >= 0").select("chunk", "bucket", "n", "counts").groupBy("chunk")).applyInArrow(_send_bigrams(buckets, words, hot), _BIGRAMS)
    sums = S.written(sent.groupBy("bucket").applyInArrow(_sum_bigrams(words, hot), _SUMS), "sums")
    n = sums.filter("kind = 2").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(K + 1))).first()
    d = discounts(np.array(n[:]))
    # at most tokens / hot contexts, by the choice of hot
    often = sums.filter("kind = 3").groupBy("chunk").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 2)), F.max(F.col("stats")[K + 2]).alias("c")).toPandas()
    weights = dict(zip(often["chunk"].tolist(), backoff_weights(often.drop(columns="chunk").to_numpy(np.float64), d).tolist(), strict=True)) if len(often) else {}
    out = sums.filter("kind < 2").groupBy("chunk").applyInArrow(_finish(d, weights), _SCORES)
    return out.select(S.id_back().alias(id_col), "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
