"""Benchmark decontamination by greedy string tiling."""

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

#: Benchmark items that are sent to the tasks together.
BLOCK_ITEMS = 20_000
_RESULT = "k long, item long, coverage double, n_tiles int, longest int, covered int, n_words int"


def normal_words(texts: pa.Array) -> T.Words:
    """Lower-cased words of letters and digits; punctuation separates."""
    return T.words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), separators=T.NOT_ALNUM)


def tile(test: np.ndarray, text: np.ndarray, test_at: np.ndarray, text_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping matches (test start, text start, length), longest first.

    test, text: word hashes; test_at, text_at: places where `least` words agree by their rolling (Karp-Rabin) hash.
    Each round extends the seeds over unmarked words, marks the longest match (first by test place, then by text
    place) and drops seeds that are covered, until no unmarked match of `least` words is left.
    """
    tiles = []
    free_test, free_text = np.ones(len(test), bool), np.ones(len(text), bool)
    while len(test_at):
        run = np.zeros(len(test_at), np.int64)
        live = np.ones(len(test_at), bool)
        step = 0
        while live.any():
            a, b = test_at + step, text_at + step
            live &= (a < len(test)) & (b < len(text))
            i = np.flatnonzero(live)
            same = (test[a[i]] == text[b[i]]) & free_test[a[i]] & free_text[b[i]]
            live[i[~same]] = False
            run[i[same]] += 1
            step += 1
        best = run.max()
        if best < least:
            break
        # all matches of this length in turn, as far as they do not overlap
        for i in np.flatnonzero(run == best)[np.lexsort((text_at[run == best], test_at[run == best]))]:
            a, b = int(test_at[i]), int(text_at[i])
            if free_test[a : a + best].all() and free_text[b : b + best].all():
                free_test[a : a + best] = free_text[b : b + best] = False
                tiles.append((a, b, int(best)))
        keep = (run >= least) & free_test[test_at] & free_text[text_at]
        test_at, text_at = test_at[keep], text_at[keep]
    return tiles


@dataclass
class Tests:
    """A block of benchmark items with their seeds: for each seed length the sorted hashes, and the item and place of each."""

    items: np.ndarray
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def tests_of(items: np.ndarray, texts: pa.Array, least: int) -> Tests:
    w = normal_words(texts)
    n = np.diff(w.first)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for k in sorted({min(least, int(x)) for x in n if x}):
        at = T.inside_text(w.first, k)
        at = at[np.minimum(n[w.text_of[at]], least) == k]
        h, doc = T.rolling(w.hash, k)[at], w.text_of[at]
        order = np.argsort(h, kind="stable")
        seeds[k] = h[order], doc[order], (at - w.first[doc])[order]
    return Tests(items, [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)], seeds)


def _search(shared_tests, least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared_tests.value
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("k").to_numpy()
            for lo, hi in T.slices(texts):
                w = normal_words(texts.slice(lo, hi - lo))
                out = []
                for k, (keys, item_of, place_of) in tests.seeds.items():
                    at = T.inside_text(w.first, k)
                    h = T.rolling(w.hash, k)[at] if len(at) else np.empty(0, np.uint64)
                    a = np.searchsorted(keys, h)
                    hit = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == h)
                    if not len(hit):
                        continue
                    first, many = a[hit], np.searchsorted(keys, h[hit], "right") - a[hit]
                    seed = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    spot = np.repeat(at[hit], many)
                    doc, item = w.text_of[spot], item_of[seed]
                    order = np.lexsort((spot, item, doc))
                    doc, item, spot, place = doc[order], item[order], spot[order], place_of[seed][order]
                    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
                    for x, y in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]]), strict=True):
                        d, t = int(doc[x]), int(item[x])
                        test = tests.words[t]
                        reach = np.zeros(len(test) + k, bool)
                        for j in range(k):
                            reach[place[x:y] + j] = True
                        if reach[: len(test)].sum() < threshold * len(test):
                            continue  # even all shared seeds together cover too little
                        tiles = tile(test, w.hash[w.first[d] : w.first[d + 1]], place[x:y], spot[x:y] - w.first[d], k)
                        covered = sum(n for *_, n in tiles)
                        if covered >= threshold * len(test):
                            out.append((int(ids[lo + d]), int(tests.items[t]), covered / len(test), len(tiles), max(n for *_, n in tiles), covered, len(test)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "item", "coverage", "n_tiles", "longest", "covered", "n_words"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and a benchmark item of which greedy string tiling covers `threshold` of the words or more.

    Seeds are runs of `min_tile` words of an item; items with fewer words are one seed. The benchmark goes to the
    tasks in blocks of at most BLOCK_ITEMS items, so nothing of unknown size is broadcast; each block is one pass over
    the documents without a shuffle. Tiles may come in any order, so reordered passages count.

    Returns doc_id, item_id, coverage, n_tiles, longest, covered, n_words, one row per input row pair. Null or empty
    texts and items without words match nothing. Repeated rows each return; a null id stays null.
    """
    if min_tile < 1 or not 0 < threshold <= 1:
        raise ValueError("min_tile must be at least 1 and threshold within (0, 1]")
    spark = docs.sparkSession
    texts = S.texts_of(docs, id_col, text_col)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(S.NO_ID)).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    blocks = S.parts(items.count(), BLOCK_ITEMS)
    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        table = block.toArrow().sort_by([("item", "ascending"), ("text", "ascending")]).combine_chunks()
        tests = tests_of(table["item"].to_numpy(), S.one_array(table["text"]) if table.num_rows else pa.array([], pa.string()), min_tile)
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(tests), min_tile, threshold), _RESULT)
        out = found if out is None else out.unionByName(found)
    return out.select(S.id_back().alias(id_col), S.id_back("item").alias(item_col), "coverage", "n_tiles", "longest", "covered", "n_words")
