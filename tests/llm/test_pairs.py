"""N-gram join, suffix and substring dedup against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ids_and_texts, jaccard_components, key, odd_documents, repeated_windows, sentence, words_of
from pyspark.sql import functions as F

from trovelight.llm import ngram_join as nj
from trovelight.llm import shared, suffix
from trovelight.llm.components import connected
from trovelight.llm.ngram_join import ngram_join
from trovelight.llm.registry import op7_suffix_dedup
from trovelight.llm.substring import substring_dedup
from trovelight.llm.suffix import _send_phrases, suffix_dedup


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def check_join(docs, words, num):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join(docs, words=words, num=num).collect()), key=key)
    assert got == sorted(jaccard_components(ids_and_texts(docs), words, num), key=key)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(docs, odd, words, num):
    check_join(docs, words, num)
    check_join(odd, words, num)


def near_copies(n, most, seed=5):
    """Copies of one text, each with other words changed: many similar pairs just miss the threshold."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{j}" for j in range(60)]
        for _ in range(rng.randrange(1, most)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [6000, 7])
@pytest.mark.parametrize("rounds", [2, 0])
def test_join_of_near_copies_in_one_tree_and_in_blocks(spark, monkeypatch, rows, rounds):
    monkeypatch.setattr(nj, "TREE_ROWS", rows)
    monkeypatch.setattr(nj, "UNIT_ROUNDS", rounds)
    docs = spark.createDataFrame(near_copies(60, 4), "doc_id long, text string")
    check_join(docs, 3, 80)
    check_join(docs, 3, 90)


@pytest.mark.parametrize("tokens", [4 << 20, 40_000])
def test_groups_that_overlap_share_the_sets_they_are_sent(spark, monkeypatch, tokens):
    """Trees of whole groups: a set goes once to a task, however many of the task's groups hold it."""
    made, old = [], nj.S.written
    monkeypatch.setattr(nj.S, "written", lambda df, name: made.append((name, old(df, name))) or made[-1][1])
    monkeypatch.setattr(nj.S, "discard", lambda *tables: None)
    monkeypatch.setattr(nj, "UNIT_ROUNDS", 0)
    monkeypatch.setattr(nj, "PART_TOKENS", tokens)
    check_join(spark.createDataFrame(near_copies(80, 4, seed=8), "doc_id long, text string"), 3, 80)
    tables = dict(made)
    rows, sent = tables["trees"], tables["tasks"]
    assert sent.count() == sent.distinct().count() and 2 * sent.count() < rows.count()
    assert {r["cls"] for r in sent.collect()} == {r["cls"] for r in rows.collect()}
    assert (sent.select("part").distinct().count() > 1) == (tokens == 40_000)


def test_tasks_give_back_fewer_links_than_they_have_sets(spark, monkeypatch):
    """5,000 near copies: all of them are one component or pairs that just miss, and no task returns pairs."""
    made, old = [], nj.S.written
    monkeypatch.setattr(nj.S, "written", lambda df, name: made.append((name, old(df, name))) or made[-1][1])
    monkeypatch.setattr(nj.S, "discard", lambda *tables: None)
    monkeypatch.setattr(nj, "TREE_ROWS", 1000)
    rows = near_copies(5000, 3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), num=80).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for _, t in rows]
    by_token, parent = {}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):  # a text is compared with one of each component that it shares a token with, then with all
        for j in {x for t in s for x in by_token.get(t, ())[:3]}:
            if root(i) != root(j) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for t in s:
            by_token.setdefault(t, []).append(i)
    apart = [i for i in range(len(rows)) if root(i) != root(0)]
    for i in apart:
        for j in range(len(rows)):
            if root(i) != root(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(rows))}
    assert max(t.count() for name, t in made if name == "links") < 2 * len(rows)


def test_join_writes_few_files_and_sends_small_batches(spark, monkeypatch):
    """Each file that a task writes makes its JVM start a process, so their number does not follow the tasks that read."""
    made, sizes, old, name = [], set(), nj.S.written, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def written(df, what):
        sizes.add(int(spark.conf.get(name)))
        out = old(df, what)
        made.append((what, len(out.inputFiles())))
        return out

    monkeypatch.setattr(nj.S, "written", written)
    docs = spark.createDataFrame(near_copies(60, 4), "doc_id long, text string").repartition(40)
    check_join(docs, 3, 80)
    assert dict(made)["classes"] <= 4 and sum(n for _, n in made) < 2 * len(made)
    assert max(sizes) <= shared.BATCH_ROWS and spark.conf.get(name) == before


def test_short_equal_sets_send_no_keys():
    rule = nj.Rule(3, 90, 100)
    off = np.concatenate([[0], np.cumsum(np.arange(1, 9))])
    assert not len(nj.segment_keys(np.random.default_rng(1).integers(0, 1 << 54, off[-1], dtype=np.uint64), off, rule)[0])


@pytest.mark.parametrize("num", [50, 66, 100])
def test_partners_more_than_one_band_apart(spark, num):
    rng, rows = random.Random(num), []
    for n in (1, 2, 3, 5, 19, 62, 93, 140):
        w = sentence(rng, -(-n * 100 // num)).split()
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:n]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join(docs, words=1, num=num).collect()}
    assert got == {k: c for k, _, c in jaccard_components(rows, 1, num)}


def test_linked_pairs_share_a_band_and_the_keys_they_need():
    for num in (5, 20, 34, 50, 66, 80, 90):
        rule = nj.Rule(1, num, 100)
        b, n = nj.bands(rule), np.arange(1, 1500)
        low, need = nj.lowest_band(n, rule), nj.needed(n, rule)
        for x in n[:600]:
            y = n[(n >= x) & (n * num <= x * 100)]
            own = np.searchsorted(b.lows, x, "right") - 1
            assert (low[y - 1] <= own).all() and (np.maximum(need[y - 1], need[x - 1]) <= b.shared[own]).all()


def some_sets(many, size=80, seed=4):
    rng = np.random.default_rng(seed)
    bases = rng.integers(0, 1 << 54, (3, size), dtype=np.uint64)
    sets = []
    for i in range(many):
        keep = bases[i % 3][rng.random(size) > rng.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 54, rng.integers(0, 12), dtype=np.uint64)])))
    return sets


@pytest.mark.parametrize("fold", [4, 1])
def test_traversal_keeps_every_linked_pair(monkeypatch, fold):
    """With FOLD 1, tokens share bits and overlaps are upper bounds."""
    monkeypatch.setattr(nj, "FOLD", fold)
    rule, sets = nj.Rule(3, 80, 100), some_sets(150)
    n = np.array([len(s) for s in sets])
    none = np.zeros(150, np.int64)
    rows = nj.Rows(np.arange(150), np.arange(150), n, none, none, np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
    bit, held, words, exact = nj.bitmaps(rows)
    assert exact.all() == (fold == 4)
    bits = np.zeros((150, words[0]), np.uint64)
    at = np.flatnonzero(bit >= 0)
    spot = bit[at] % (int(words[0]) * 64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(150), n)[at], spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
    for trees in (none, np.arange(150) // 75):
        levels = nj.signature_trees(bits, n, held, np.arange(150), trees)
        roots = (np.array([0]), np.array([0])) if trees.max() == 0 else (np.array([0, 1, 0]), np.array([0, 1, 1]))
        got = {(min(i, j), max(i, j)) for a, b in nj.dual_traversal(levels, *roots, rule, step=50) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for j in range(150) for i in range(j) if rule.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j])))}
        assert want <= got and len(got) < 150 * 149 // 2 and (fold == 1 or want == got)
    one = nj.signature_trees(bits, n, held, none, none)
    assert not list(nj.dual_traversal(one, np.array([0]), np.array([0]), rule))  # one component already


@pytest.mark.parametrize("fold", [4, 1])
def test_links_of_units_connect_what_links(monkeypatch, fold):
    monkeypatch.setattr(nj, "FOLD", fold)
    rule, sets = nj.Rule(3, 80, 100), some_sets(120, seed=9)
    n = np.array([len(s) for s in sets])
    unit, tree = np.repeat([0, 1, 2], 40), np.concatenate([np.zeros(80, np.int64), np.repeat([0, 1], 20)])
    rows = nj.Rows(np.arange(120), np.arange(120), n, unit, tree, np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
    label = np.arange(120)
    nj.unite(label, *nj._links_of(rows, rule, np.array([False, False, True])))
    meet = lambda i, j: unit[i] == unit[j] and (unit[i] < 2 or tree[i] != tree[j])
    pairs = [(i, j) for j in range(120) for i in range(j) if meet(i, j) and rule.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j])))]
    want = np.arange(120)
    nj.unite(want, *(np.array(x) for x in zip(*pairs, strict=True)))
    assert (label == want).all() and len(set(want)) > 3


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected(links).collect()} == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6}
    assert connected(links.limit(0)).count() == 0


def words_brute(docs, n):
    rows = ids_and_texts(docs)
    out = []
    for (k, t), gone in zip(rows, repeated_windows([words_of(t) for _, t in rows], n), strict=True):
        kept = b" ".join(w for w, g in zip(words_of(t), gone, strict=True) if not g)
        out.append((k, len(gone), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [35, 8])
def test_substring_equals_brute_force(docs, odd, window, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK_BYTES", 60_000)
    for table in (docs, odd):
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring_dedup(table, window=window).collect()), key=key)
        assert got == words_brute(table, window)


@pytest.mark.parametrize("last", [9, None])
def test_substring_of_ids_whose_last_text_is_shorter(spark, last):
    base = sentence(random.Random(8), 120)
    rows = [(1, base), (last, base), (last, "z"), (last, ""), (last, None), (last, "z " + base[:300])]
    docs = spark.createDataFrame(rows if last else rows[1:] + rows[1:], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring_dedup(docs).collect()), key=key)
    assert got == words_brute(docs, 35)


def bytes_brute(docs, n):
    rows = [(k, (t or "").encode()) for k, t in ids_and_texts(docs)]
    out = []
    for (k, b), gone in zip(rows, repeated_windows([b for _, b in rows], n), strict=True):
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("length", [400, 240, 200])
def test_suffix_equals_brute_force(docs, odd, length, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK_BYTES", 60_000)
    for table in (docs, odd):
        found = suffix_dedup(table, length=length).collect()
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=key)
        assert got == bytes_brute(table, length)
        for r in found:
            assert (r["kept"] is None) == (r["n_removed"] == 0)
            assert r["kept"] is None or hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_suffix_counts_shorter_repeats_beside_what_it_removes(docs, odd, monkeypatch):
    monkeypatch.setattr(shared, "CHUNK_BYTES", 60_000)
    for table in (docs, odd):
        found = suffix_dedup(table, length=400, also=240).collect()
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=key)
        assert got == bytes_brute(table, 400)
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_repeated"]) for r in found), key=key) == sorted((x[:3] for x in bytes_brute(table, 240)), key=key)


def test_op7_shows_passages_of_over_fifty_words(spark, tmp_path):
    """Such a passage can be shorter than the 400 bytes that are removed."""
    rng = random.Random(2)
    passage = " ".join(rng.choice("a bird sang at dawn over low wet hay".split()) + str(rng.randrange(9)) for _ in range(52))
    rows = [(i, sentence(rng, 60) + (" " + passage + " " if i < 2 else " ") + sentence(rng, 60)) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert 240 < len(passage) < 398 and all(r["n_removed"] == 0 for r in found.values())
    assert [len(passage) <= found[i]["n_repeated"] <= len(passage) + 10 for i in range(6)] == [True, True] + [False] * 4
    assert all(found[i]["n_repeated"] == 0 for i in range(2, 6))


def test_suffix_ranks_one_of_all_equal_texts_and_starts_with_two_phrases(spark, monkeypatch):
    rng = random.Random(3)
    long, passage = sentence(rng, 400), sentence(rng, 100)
    rows = [(1, long)] * 40 + [(2, long), (3, long[:50])] + [(i, sentence(rng, 60) + " " + passage + " " + sentence(rng, 60)) for i in range(4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds, real = [], suffix.doubled

    def doubled(ranks, offset):
        rounds.append((offset, ranks.count(), ranks.select("u", "m").distinct().count(), ranks.select("u").distinct().count()))
        return real(ranks, offset)

    monkeypatch.setattr(suffix, "doubled", doubled)
    found = suffix_dedup(docs, also=240).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=key) == bytes_brute(docs, 400)
    ((offset, n, places, texts),) = rounds
    assert offset == 2 and n == places and texts == 5  # nothing of the equal texts repeats elsewhere
    suffix_dedup(docs, length=240).collect()
    assert len(rounds) == 1  # two phrases are all that windows of 240 bytes must hold


def test_rising_order_of_hashes_with_equal_high_bits():
    rng = np.random.default_rng(5)
    for h in (rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 300, 5000).astype(np.uint64) * np.uint64(7), np.array([5], np.uint64)):
        order = shared.rising(h)
        assert (np.sort(order) == np.arange(len(h))).all() and (h[order] == np.sort(h)).all()


def test_empty_tables(docs):
    none = docs.limit(0)
    for table in (ngram_join(none), substring_dedup(none), suffix_dedup(none)):
        assert table.count() == 0


def test_ten_thousand_texts_without_id(spark, monkeypatch):
    """They spread over many chunks and are told apart by their texts."""
    monkeypatch.setattr(shared, "CHUNK_BYTES", 100_000)
    rng = random.Random(12)
    passages = [sentence(rng, 70) for _ in range(20)]
    rows = [(None, sentence(rng, 12) + (" " + passages[i % 20] if i % 50 == 0 else "")) for i in range(10_000)] + [(None, passages[3])] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring_dedup(docs).collect()), key=key)
    assert got == words_brute(docs, 35)
    found = suffix_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=key) == bytes_brute(docs, 400)


def test_arguments(docs):
    for call in (lambda: ngram_join(docs, words=0), lambda: substring_dedup(docs, window=1), lambda: suffix_dedup(docs, length=100)):
        with pytest.raises(ValueError):
            call()


def test_other_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "my_id int, body string")
    assert {r["component_id"] for r in ngram_join(docs, id_col="my_id", text_col="body").collect()} == {1}
    assert docs.count() == substring_dedup(docs, id_col="my_id", text_col="body").filter(F.col("n_removed") == 0).count()


def test_likely_in_keeps_all_wanted_rows_and_few_others(spark, monkeypatch):
    rows = spark.range(-20_000, 20_000).selectExpr("if(id = 7, null, id * 7919) as u", "cast(id as string) as text")
    wanted = spark.range(-500, 500).selectExpr("if(id = 3, null, id * 7919) as w")
    keys = {r["w"] for r in wanted.collect()} - {None}
    for bits in (26, 15):
        monkeypatch.setattr(shared, "FILTER_BITS", bits)
        found = [r["u"] for r in shared.likely_in(rows, "u", wanted).collect()]
        assert keys - {7 * 7919} <= set(found) and len(found) == len(set(found)) < 5_000
    assert shared.likely_in(rows, "u", wanted.limit(0)).count() == 0 and shared.likely_in(rows.limit(0), "u", wanted).count() == 0
    assert shared.likely_in(rows, "u", wanted).columns == ["u", "text"]


def test_phrases_of_a_task_take_little_memory_and_go_in_pieces():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["u", "text"])
    tracemalloc.start()
    try:
        sent = list(_send_phrases(240, 64)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20
    assert len(sent) > 1 and max(b.nbytes for b in sent) <= shared.BATCH_BYTES * 3 // 2
    assert [r for b in sent for r in b["bucket"].to_pylist()] == list(range(64))
