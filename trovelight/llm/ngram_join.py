"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets form classes. Each class cuts its set into segments by token value; two sets that
link differ in fewer tokens than there are segments, so they agree in some of them, and classes with an equal segment
are a group. Groups say which sets can meet at all. Within a unit, each set is first verified against the middle one; what
that leaves comes from signature trees over the sets, whose nodes hold OR-combined token bitmaps, size ranges and
components. A dual traversal drops pairs of nodes whose largest possible overlap is too small, or that are one component
already, and verifies what reaches the leaves.

Trees are built for units: each class is dealt to one, so that most groups lie in a unit whole. Groups of several
components that no unit held whole are dealt again, as far as their classes have as many keys in such groups as a
linked pair shares, and at last go through trees group by group. A tree task gives back links between components,
fewer than it has sets; pairs never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import shared as S
from trovelight.llm import textarrays as T
from trovelight.llm.components import connected

TOKEN_BITS = 54
MAX_TEXTS = 1 << (64 - TOKEN_BITS)
FANOUT = 8
#: Sets, and tokens of sets, of a group that are one block; blocks of a group are in trees of their own.
TREE_ROWS, TREE_TOKENS = 6000, 3 << 20
#: A bitmap has at most so many bits for each token of the largest set of its tree.
FOLD = 4
FLUSH = 1 << 20
#: Tokens that one task takes, and that it takes at a time.
PART_TOKENS, BATCH_TOKENS = 4 << 20, 1 << 20
#: Times that classes are dealt to units before what is still open goes through trees group by group.
UNIT_ROUNDS = 2
#: Pairs that are verified before components are looked at again.
PAIRS = 5000


@dataclass(frozen=True)
class Rule:
    """Two sets link if den * intersection >= num * union."""

    words: int
    num: int
    den: int

    def linked(self, x, y, both):
        return both * (self.num + self.den) >= self.num * (x + y)


@dataclass(frozen=True)
class Bands:
    """By band of set sizes: the smallest size, by how many tokens a linked pair may differ whose smaller set is in the
    band, how many segments a set is cut into, how many empty ones it has when it sends them, and the keys that such a
    pair shares at least."""

    lows: np.ndarray
    differ: np.ndarray
    segments: np.ndarray
    empty: np.ndarray
    shared: np.ndarray


@lru_cache
def bands(rule: Rule, top: int = 1 << 40) -> Bands:
    lows = [1]
    while lows[-1] < top:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    lows = np.array(lows)
    differ = (lows[1:] - 1) * (rule.den - rule.num) // rule.num  # tokens by which a linked pair may differ
    # more segments than that: some of those that agree may be empty on both sides and then are not sent
    spare, empty = 8 + differ * 3 // 10, 4 + differ // 5
    return Bands(lows[:-1], differ, differ + spare, empty, spare - empty + 1)


def lowest_band(n: np.ndarray, rule: Rule) -> np.ndarray:
    """The band of the smallest partner that a set of n tokens may link with."""
    return np.maximum(np.searchsorted(bands(rule).lows, -(-n * rule.num // rule.den), "right") - 1, 0)


def needed(n: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys that a set shares with any linked partner: the least bound from its smallest partner's band up."""
    least = np.minimum.accumulate(bands(rule).shared[::-1])[::-1]
    return least[lowest_band(n, rule)]


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of one slice, sorted, and their offsets."""
    w = T.words(texts, lower=True)
    n = np.diff(w.first)
    at = T.inside_text(w.first, words)
    h = [T.rolling(w.hash, words)[at]] if len(at) else []
    doc = [w.text_of[at]]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        h.append(T.mix(T.span_hash(w.hash, w.first[short], w.first[short + 1]) + n[short].astype(np.uint64)))
        doc.append(short)
    key = (np.concatenate(doc).astype(np.uint64) << np.uint64(TOKEN_BITS)) | (np.concatenate([np.empty(0, np.uint64), *h]) >> np.uint64(64 - TOKEN_BITS))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & np.uint64((1 << TOKEN_BITS) - 1), np.searchsorted(key >> np.uint64(TOKEN_BITS), np.arange(len(texts) + 1))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for lo, hi in T.slices(texts, T.SMALL_SLICE_BYTES):
        for x in range(lo, hi, MAX_TEXTS):
            yield x, min(x + MAX_TEXTS, hi)


def _classes(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """63-bit class of each set; 0 for an empty one."""
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(tokens + np.uint64(1)), dtype=np.uint64)])
    n = np.diff(off)
    d = T.mix((c[off[1:]] - c[off[:-1]]) ^ T.mix(n.astype(np.uint64) + np.uint64(77))) >> np.uint64(1)
    return np.where(n > 0, np.maximum(d, 1), 0).astype(np.int64)


def _describe(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _pieces(batch.column("text")):
                tokens, off = _sets(batch.column("text").slice(lo, hi - lo), rule.words)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), batch.column("u").slice(lo, hi - lo), pa.array(np.diff(off).astype(np.int64)), pa.array(_classes(tokens, off)), pa.array(needed(np.diff(off), rule))], names=["k", "u", "n", "cls", "need"])

    return run


def segment_keys(tokens: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all segments, and the text of each.

    A set goes to its own band and to all below in which a smaller partner may be, but to none whose sets link with
    equal ones only: these are one class. Empty segments are keys only for sets that have many of them.
    """
    n = np.diff(off)
    band_of = bands(rule)
    lows = band_of.lows
    own, least = np.searchsorted(lows, n, "right") - 1, lowest_band(n, rule)
    keys, owners = [], []
    for down in range(int((own - least).max(initial=0)) + 1):
        band = own - down
        use = np.flatnonzero((n > 0) & (band >= least) & (band_of.differ[np.maximum(band, 0)] > 0))
        if not len(use):
            continue
        k = band_of.segments[band[use]]
        start = np.concatenate([[0], np.cumsum(k)])
        size = n[use]
        at = np.repeat(off[:-1][use] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        t = tokens[at]
        many = np.repeat(k, size).astype(np.uint64)
        seg = ((t >> np.uint64(TOKEN_BITS - 32)) * many) >> np.uint64(32)
        cell = np.repeat(start[:-1], size) + seg.astype(np.int64)
        total = np.zeros(start[-1], np.uint64)
        np.add.at(total, cell, T.mix(t + np.uint64(1)))
        held = np.bincount(cell, minlength=start[-1])
        text = np.repeat(np.arange(len(use)), k)
        empty = np.bincount(text[held == 0], minlength=len(use))
        keep = (held > 0) | (empty >= band_of.empty[band[use]])[text]
        number = np.arange(start[-1]) - start[:-1][text]
        key = T.mix(total ^ T.mix((band[use][text].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)))
        keys.append(key[keep])
        owners.append(use[text[keep]])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _send_keys(rule: Rule, buckets: int):
    def flush(keys, classes) -> pa.RecordBatch:
        k, c = np.concatenate(keys), np.concatenate(classes)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        k, c = k[new], c[new]
        rows = [(b, hi - lo, S.pack_sorted(k[lo:hi]), c[lo:hi].tobytes()) for b, lo, hi in S.bucket_bounds(k, buckets)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "n", "keys", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, n = [], [], 0
        for batch in batches:
            for lo, hi in _pieces(batch.column("text")):
                tokens, off = _sets(batch.column("text").slice(lo, hi - lo), rule.words)
                k, owner = segment_keys(tokens, off, rule)
                keys.append(k)
                classes.append(_classes(tokens, off)[owner])
                n += len(k)
                if n >= FLUSH:
                    yield from S.in_pieces(flush(keys, classes))
                    keys, classes, n = [], [], 0
        if n:
            yield from S.in_pieces(flush(keys, classes))

    return run


def _members(table: pa.Table) -> pa.Table:
    """Of one bucket: the groups of two classes or more (a hash of these classes), their classes, and how many keys of
    the bucket have just these."""
    k = np.concatenate([S.unpack_sorted(b, n) for b, n in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)])
    c = np.concatenate([np.frombuffer(b, np.int64) for b in table["classes"].to_pylist()])
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    k, c = k[new], c[new]
    begin = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, len(k)))
    who = np.add.reduceat(T.mix(c.view(np.uint64)), first) if len(k) else k
    group = np.cumsum(begin) - 1
    keep = size[group] > 1
    found = pa.table([T.mix(who ^ size.astype(np.uint64)).view(np.int64)[group][keep], c[keep]], names=["key", "cls"])
    return found.group_by(["key", "cls"]).aggregate([([], "count_all")]).rename_columns(["key", "cls", "w"])


def _whole_sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _pieces(batch.column("text")):
                tokens, off = _sets(batch.column("text").slice(lo, hi - lo), rule.words)
                own = [S.pack_sorted(tokens[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_classes(tokens, off)), pa.array(np.diff(off).astype(np.int64)), pa.array(own, pa.binary())], names=["cls", "n", "tokens"])

    return run


@dataclass
class Level:
    """Nodes of one height of all signature trees of a batch."""

    bits: np.ndarray  #: OR of the token bitmaps below
    least: np.ndarray  #: smallest set size below
    most: np.ndarray
    shared: np.ndarray  #: most tokens of one set that fall on a bit another of its tokens has set
    part: np.ndarray  #: component, if all below have one; else -1
    begin: np.ndarray  #: first child, one level lower
    kids: np.ndarray


def signature_trees(bits: np.ndarray, n: np.ndarray, held: np.ndarray, part: np.ndarray, tree: np.ndarray) -> list[Level]:
    """Levels from the leaves (one set each) to the roots, one for each value of `tree`; rows come sorted by tree.
    held: tokens of each set that have a bit at all."""
    none = np.zeros(len(n), np.int64)
    levels = [Level(bits, n, n, held - np.bitwise_count(bits).sum(1).astype(np.int64), part, none, none)]
    while True:
        x = levels[-1]
        edge = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        size = np.diff(np.append(edge, len(tree)))
        if size.max() == 1 and len(levels) > 1:
            return levels
        place = np.arange(len(tree)) - np.repeat(edge, size)
        at = np.flatnonzero(place % FANOUT == 0)
        low, high = np.minimum.reduceat(x.part, at), np.maximum.reduceat(x.part, at)
        levels.append(Level(np.bitwise_or.reduceat(x.bits, at, axis=0), np.minimum.reduceat(x.least, at), np.maximum.reduceat(x.most, at), np.maximum.reduceat(x.shared, at), np.where(low == high, low, -1), at, np.diff(np.append(at, len(tree)))))
        tree = tree[at]


def _children(x: Level, node: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = x.kids[node]
    first = np.repeat(x.begin[node], many)
    return first + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(rest, many)


def dual_traversal(levels: list[Level], a: np.ndarray, b: np.ndarray, rule: Rule, step: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From pairs of roots (a, b) to pairs of leaves in different components whose largest possible overlap would link
    them. A tree against itself is the pair of its root with itself."""
    todo = [(len(levels) - 1, a, b)]
    while todo:
        i, a, b = todo.pop()
        if len(a) > step:
            todo += [(i, a[x : x + step], b[x : x + step]) for x in range(0, len(a), step)]
            continue
        x = levels[i]
        keep = (x.most[a] * rule.den >= x.least[b] * rule.num) & (x.most[b] * rule.den >= x.least[a] * rule.num)
        keep &= (x.part[a] == -1) | (x.part[a] != x.part[b])
        if i == 0:
            keep &= a != b
        a, b = a[keep], b[keep]
        common = np.bitwise_count(x.bits[a] & x.bits[b]).sum(1).astype(np.int64)
        most = np.minimum.reduce([x.most[a], x.most[b], x.shared[a] + common, x.shared[b] + common])
        keep = rule.linked(x.least[a], x.least[b], most)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if i == 0:
            yield a, b
            continue
        twin = a == b
        a, origin = _children(x, a, np.arange(len(a)))
        b, again = _children(x, b[origin], np.arange(len(a)))
        a, twin = a[again], twin[origin][again]
        keep = ~twin | (a <= b)
        todo.append((i - 1, a[keep], b[keep]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked rows, and all that share a label with them, the smallest label. Labels are row numbers."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


@dataclass
class Rows:
    """Sets of some tree units, sorted by unit and block."""

    cls: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    unit: np.ndarray  #: number of the unit, from 0 without gaps
    tree: np.ndarray  #: number of the unit's block
    tokens: np.ndarray
    off: np.ndarray

    def take(self, order: np.ndarray) -> Rows:
        size = self.n[order]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(self.off[:-1][order], size)
        return Rows(self.cls[order], self.comp[order], self.n[order], self.unit[order], self.tree[order], self.tokens[at], off)


def bitmaps(r: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: number of the bit of each of its tokens that another set of its unit has as well (-1 for others), by
    token; how many such tokens; the unit's bitmap width in 64-bit words, a power of two; whether all of the unit's
    tokens have bits of their own, so that overlaps of bitmaps are exact."""
    row = np.repeat(np.arange(len(r.n)), r.n)
    h = T.mix(r.tokens ^ T.mix(r.unit[row].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, bool)
    start = np.flatnonzero(first)
    many = np.diff(np.append(start, len(h))) > 1
    run = np.cumsum(first) - 1
    # shared tokens are numbered within their unit
    units = int(r.unit[-1]) + 1 if len(r.unit) else 0
    of = r.unit[row[order[start[many]]]]
    by = np.argsort(of, kind="stable")
    width = np.bincount(of, minlength=units)
    place = np.empty(len(of), np.int64)
    place[by] = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
    number = np.full(len(start), -1, np.int64)
    number[many] = place
    bit = np.empty(len(h), np.int64)
    bit[order] = number[run]
    largest = np.zeros(units, np.int64)
    np.maximum.at(largest, r.unit, r.n)
    need, fold = np.maximum(width, 1), np.maximum(FOLD * largest, 64)
    words = np.array([max(1, 1 << (int(x) - 1).bit_length() >> 6) for x in np.minimum(need, fold)], np.int64) if units else np.empty(0, np.int64)
    held = np.bincount(row[bit >= 0], minlength=len(r.n)).astype(np.int64)
    return bit, held, words[r.unit], (width <= words * 64)[r.unit]


def _links_of(r: Rows, rule: Rule, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between components that the units show, one less than what they unite at most. across: by unit, whether
    its two blocks meet each other; else all its sets meet."""
    bit, held, words, exact = bitmaps(r)
    label = np.arange(len(r.n))
    # one label for each component of a unit
    order = np.lexsort((r.comp, r.unit))
    same = (r.unit[order][1:] == r.unit[order][:-1]) & (r.comp[order][1:] == r.comp[order][:-1])
    unite(label, order[:-1][same], order[1:][same])

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Verifies pairs that bitmaps let pass and unites those that link."""
        for x in range(0, len(a), PAIRS):
            i, j = a[x : x + PAIRS], b[x : x + PAIRS]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            sure = exact[i]
            unite(label, i[sure], j[sure])
            for p, q in zip(i[~sure].tolist(), j[~sure].tolist(), strict=True):
                if label[p] != label[q]:
                    both = np.intersect1d(r.tokens[r.off[p] : r.off[p + 1]], r.tokens[r.off[q] : r.off[q + 1]], assume_unique=True)
                    if rule.linked(r.n[p], r.n[q], len(both)):
                        unite(label, np.array([p]), np.array([q]))

    row = np.repeat(np.arange(len(r.n)), r.n)
    for w in np.unique(words):
        mine = np.flatnonzero(words == w)
        at = np.flatnonzero((bit >= 0) & (words[row] == w))
        local = np.cumsum(words == w) - 1
        bits = np.zeros((len(mine), int(w)), np.uint64)
        spot = bit[at] % (int(w) * 64)
        np.bitwise_or.at(bits, (local[row[at]], spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
        # first each set with the middle one of its unit, so that components are known before the trees are built
        edge = np.flatnonzero(np.concatenate([[True], r.unit[mine][1:] != r.unit[mine][:-1]]))
        size = np.diff(np.append(edge, len(mine)))
        hub = np.repeat(edge + size // 2, size)
        try_hub = np.flatnonzero((hub != np.arange(len(mine))) & ~across[r.unit[mine]])
        common = np.bitwise_count(bits[try_hub] & bits[hub[try_hub]]).sum(1).astype(np.int64)
        lost = held[mine] - np.bitwise_count(bits).sum(1).astype(np.int64)
        fits = rule.linked(r.n[mine[try_hub]], r.n[mine[hub[try_hub]]], common + np.minimum(lost[try_hub], lost[hub[try_hub]]))
        settle(mine[try_hub[fits]], mine[hub[try_hub[fits]]])
        order = np.lexsort((r.n[mine], label[mine], r.tree[mine], r.unit[mine]))
        mine = mine[order]
        trees = np.cumsum(np.concatenate([[True], (r.unit[mine][1:] != r.unit[mine][:-1]) | (r.tree[mine][1:] != r.tree[mine][:-1])]))
        levels = signature_trees(bits[order], r.n[mine], held[mine], label[mine], trees)
        unit_of = r.unit[mine][np.concatenate([[True], trees[1:] != trees[:-1]])]
        alone = np.flatnonzero(~across[unit_of])
        pair = np.flatnonzero(across[unit_of][:-1] & (unit_of[1:] == unit_of[:-1]))
        for a, b in dual_traversal(levels, np.concatenate([alone, pair]), np.concatenate([alone, pair + 1]), rule, max(1000, (1 << 22) // int(w))):
            settle(mine[a], mine[b])
    joined = r.comp != r.comp[label]
    return r.comp[joined], r.comp[label[joined]]


def _through_trees(rule: Rule):
    def run(table: pa.Table, sets: pa.Table) -> pa.Table:
        table, sets = S.sorted_rows(table, "key", "x", "y", "block", "n", "cls"), S.sorted_rows(sets, "cls")
        packed = sets["tokens"]
        place = np.searchsorted(sets["cls"].to_numpy(), table["cls"].to_numpy())
        key, x, y = (table[c].to_numpy() for c in ("key", "x", "y"))
        n = table["n"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        upto = np.cumsum(n)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        i = 0
        while i < len(first):
            # some whole units at a time
            before = upto[first[i] - 1] if first[i] else 0
            j = max(i + 1, int(np.searchsorted(np.append(upto[first[1:] - 1], upto[-1]), before + BATCH_TOKENS, "right")))
            lo, hi = first[i], first[j] if j < len(first) else len(n)
            tokens = np.concatenate([S.unpack_sorted(b, m) for b, m in zip(packed.take(pa.array(place[lo:hi])).to_pylist(), n[lo:hi].tolist(), strict=True)])
            unit = np.repeat(np.arange(j - i), np.diff(np.append(first[i:j], hi)))
            part = Rows(table["cls"].to_numpy()[lo:hi], table["comp"].to_numpy()[lo:hi], n[lo:hi], unit, table["block"].to_numpy()[lo:hi], tokens, np.concatenate([[0], np.cumsum(n[lo:hi])]))
            found.append(_links_of(part, rule, (x != y)[first[i:j]]))
            i = j
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.table([a, b], names=["a", "b"]).group_by(["a", "b"]).aggregate([])

    return run


def homes(left: DataFrame) -> DataFrame:
    """left: (key, cls, ..). The largest group of each class: (cls, home), home being its size and key."""
    size = left.groupBy("key").agg(F.count("*").alias("m"))
    return left.join(size, "key").groupBy("cls").agg(F.max(F.struct("m", "key")).alias("home"))


def units(left: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deals each class to one tree, its unit, so that most groups lie in one unit whole.

    A class takes the largest home that any class of its groups has. Where that makes a unit too large, it is cut into
    pieces of whole homes; a home that is too large itself goes in blocks, and its first class is copied to all of them
    and connects them.
    Returns (unit, cls, comp, n, at_home), at_home being false for copies.
    """
    own = S.written(homes(left), "homes")
    best = left.join(own, "cls").groupBy("key").agg(F.max("home").alias("best"))
    met = left.join(best, "key").groupBy("cls").agg(F.max("best").alias("best"), F.first("comp").alias("comp"))
    met = S.written(met.join(own, "cls").join(sizes, "cls"), "met")
    pieces = F.expr(f"cast(greatest(count(*) div {TREE_ROWS}, sum(n) div {TREE_TOKENS}) + 1 as int)")
    whole = met.groupBy("best").agg(pieces.alias("pieces"))
    by_home = met.groupBy("home").agg(pieces.alias("blocks"), F.min("cls").alias("hub"))
    met = met.join(whole, "best").join(by_home, "home").withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    met = met.withColumn("copy", F.explode(F.when(F.col("cls") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("home"), 2 * F.col("pieces"))).otherwise(0)
    unit = F.when(F.col("blocks") > 1, F.xxhash64("home", "copy")).otherwise(F.xxhash64("best", piece))
    return met.select(unit.alias("unit"), "cls", "comp", "n", (F.col("copy") == F.col("block")).alias("at_home"))


def still_open(left: DataFrame, near: DataFrame, met: DataFrame) -> DataFrame:
    """What is left of (key, cls, w, need, comp): groups of several components that no unit held whole, as far as their
    classes have as many keys in such groups as a pair that links shares. Takes the place of the written table `left`."""
    placed = left.drop("comp").join(near.withColumnRenamed("node", "cls"), "cls", "left").join(met, "cls", "left").select("key", "cls", "w", "need", F.coalesce("root", "cls").alias("comp"), F.coalesce("unit", "cls").alias("unit"))
    placed = S.written(placed, "placed")
    several = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("unit").alias("u0"), F.max("unit").alias("u1")).filter("c0 <> c1 and u0 <> u1").select("key")
    inside = S.written(placed.join(several, "key", "left_semi").drop("unit"), "inside")
    enough = inside.groupBy("cls").agg(F.sum("w").alias("c"), F.first("need").alias("need")).filter("c >= need").select("cls")
    out = S.written(inside.join(enough, "cls", "left_semi"), "left")
    S.discard(left, placed, inside)
    return out


def by_group(left: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of trees for whole groups. Groups that have come to be of the same classes are one. In a group too large for one tree, blocks of
    its first component meet those of the others, and these meet each other.

    Groups overlap, so they go to tasks together (`near`) by the one of their classes that most groups have; where that is
    too much for a task, in pieces of whole groups."""
    same = left.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")).groupBy("m", "who").agg(F.min("key").alias("key"))
    low = left.groupBy("key").agg(F.min("comp").alias("low"))
    often = left.groupBy("cls").agg(F.count("*").alias("often"))
    rows = left.join(same.select("key"), "key", "left_semi").join(low, "key").join(sizes, "cls").join(often, "cls").withColumn("main", F.col("comp") == F.col("low"))
    pieces = lambda main: f"greatest(count_if({main}) div {TREE_ROWS}, coalesce(sum(if({main}, n, 0)), 0) div {TREE_TOKENS})"
    size = rows.groupBy("key").agg(F.expr(f"{pieces('true')} = 0").alias("one"), F.expr(f"cast({pieces('main')} + 1 as int)").alias("mains"), F.expr(f"cast({pieces('not main')} + 1 as int)").alias("rests"), F.expr("max(struct(often, cls)).cls").alias("by"))
    rows = S.written(rows.join(size, "key").select("key", "cls", "comp", "n", "main", "one", "mains", "rests", "by"), "groups")
    tasks = rows.groupBy("by").agg(F.expr(f"cast(sum(n + 100) div {PART_TOKENS} + 1 as int)").alias("tasks"))
    rows = rows.join(tasks, "by").withColumn("h", F.xxhash64("cls")).withColumn("block", F.expr("cast(if(one, 0, if(main, -1 - pmod(h, mains), pmod(h, rests))) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("if(one, array(0), sequence(if(main, 0, -mains), rests - 1))")))
    rows = rows.select("key", "cls", "comp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "n", "one", "by", "tasks")
    near = F.expr("if(one, xxhash64(by, pmod(xxhash64(key), tasks)), xxhash64(key, x, y))")
    return rows.withColumn("near", near).drop("one", "by", "tasks")


def linked_components(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """rows: a written table of (key, cls, comp, block, x, y, n, near), a tree unit being (key, x, y). Units of equal near
    go to one task, which gets each of their sets once. Links (a, b) between components."""
    much = rows.agg(F.sum(F.col("n") + 100)).first()[0] or 0
    part = F.pmod(F.xxhash64("near"), F.lit(S.parts(much, PART_TOKENS))).alias("part")
    tasks = S.written(rows.select("cls", part).distinct(), "tasks")
    sent = S.likely_in(sets, "cls", tasks.select("cls").distinct()).drop("n").join(tasks, "cls")
    members = rows.select("key", "cls", "comp", "block", "x", "y", "n", part)
    found = members.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_through_trees(rule), "a long, b long")
    return S.written(found.distinct(), "links")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Components of documents whose sets of `words`-word shingles have a Jaccard similarity of num/den or more.

    Words are runs of non-space bytes with A-Z lower-cased. A text of fewer words is one shingle, the whole sequence.

    Returns doc_id, n_shingles, component_id (smallest id reachable, itself included), one row per input row. Null or
    empty text, or one without words: 0 shingles, linked with nothing, its own component. Repeated ids and rows are
    documents of their own and link if their sets do. A null id stays null and never names a component others have.
    """
    if words < 1 or not 0 < num <= den:
        raise ValueError("words must be at least 1 and 0 < num <= den")
    with S.small_batches(docs.sparkSession):
        return _components(S.texts_of(docs, id_col, text_col), id_col, Rule(words, num, den))


def _components(texts: DataFrame, id_col: str, rule: Rule) -> DataFrame:
    """ngram_join of (k, u, text). What is left lazy at its end runs no Python."""
    total = S.total_bytes(texts)
    # a row a text is little, and a file costs more than its rows: few files, however many tasks read the texts
    rows = S.written(texts.mapInArrow(_describe(rule), "k long, u long, n long, cls long, need long").hint("rebalance"), "classes")
    classes = rows.filter("cls <> 0").groupBy("cls").agg(F.min("u").alias("u"), F.min(S.id_back()).alias("least"), F.first("need").alias("need"))
    keys = texts.mapInArrow(_send_keys(rule, S.parts(total // 20, S.BUCKET_KEYS // 2)), "bucket int, n int, keys binary, classes binary")
    members = keys.groupBy("bucket").applyInArrow(_members, "key long, cls long, w long")
    # keys of the same classes are one group, of weight w
    members = S.written(members.groupBy("key", "cls").agg(F.sum("w").alias("w")), "members")
    # classes with fewer keys than a linked pair shares have no partner
    often = members.groupBy("cls").agg(F.sum("w").alias("c")).join(classes, "cls").filter("c >= need")
    often = S.written(often.select("cls", "u", "need"), "often")
    # one text for each class; equal rows bring the same again
    asked = S.written(often.select("u").distinct(), "asked")
    sets = S.likely_in(texts, "u", asked).join(asked, "u", "left_semi").dropDuplicates(["u"]).mapInArrow(_whole_sets(rule), "cls long, n long, tokens binary")
    sets = S.written(sets, "sets")
    left = S.written(members.join(often.select("cls", "need"), "cls").withColumn("comp", F.col("cls")), "left")
    S.discard(members)
    links, rows_left = [texts.sparkSession.createDataFrame([], "a long, b long")], left.count()
    sizes, near = sets.select("cls", "n"), None
    for _ in range(UNIT_ROUNDS):
        if not rows_left:
            break
        met = S.written(units(left, sizes), "units")
        links.append(linked_components(met.withColumnRenamed("unit", "key").withColumns({x: F.lit(0) for x in ("block", "x", "y")} | {"near": F.col("key")}), sets, rule))
        near = connected(reduce(DataFrame.unionByName, links))
        left = still_open(left, near, met.filter("at_home").select("cls", "unit"))
        rows_left = left.count()
    if rows_left:
        links.append(linked_components(S.written(by_group(left, sizes), "trees"), sets, rule))
    if rows_left or near is None:
        near = connected(reduce(DataFrame.unionByName, links))
    named = classes.join(near.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select(S.id_back().alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", S.id_back()).alias("component_id"))
