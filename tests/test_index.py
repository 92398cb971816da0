"""The segmented index: appends, replays, snapshots, compaction, conflicts."""

import json

import pytest
from trovelight.operators.lexical import LexicalIndex, bm25
from trovelight.sources import index


def chunks_of(spark, texts, start=0):
    rows = [(f"s{start + i}#0", f"s{start + i}", 0, t, [float(i), 1.0]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, index.CHUNKS).coalesce(1)


TEXTS = ["red brick tower", "bread at dawn", "tower of brick and stone", None, "", "the dawn tower tower", "stone bread", "red dawn", "brick", "a lamp and a tower"]


def answers(spark, lexical, words=("brick tower", "dawn bread", "lamp")):
    asked = spark.createDataFrame(list(enumerate(words)), "qid long, text string")
    return sorted(map(tuple, bm25(lexical, asked, 5).collect()))


def test_segments_answer_as_one_index_would(spark, tmp_path):
    path = str(tmp_path / "i")
    for n, text in enumerate(TEXTS):
        index.put_batch(chunks_of(spark, [text], n), path, n)
    chunks, lexical = index.load(spark, path)
    whole = LexicalIndex.build(chunks_of(spark, TEXTS), "chunk_id", "text")
    assert chunks.count() == len(TEXTS)
    assert answers(spark, lexical) == answers(spark, whole)
    assert lexical.stats.first() == whole.stats.first()
    assert sorted(map(tuple, lexical.frequencies.collect())) == sorted(map(tuple, whole.frequencies.collect()))
    # eight segments of the lowest tier became one of the next
    assert sorted(s.tier for s in index.manifest(spark, path).segments) == [0, 0, 1]
    assert [s.rows for s in index.manifest(spark, path).segments if s.tier == 1] == [8]


def test_a_batch_writes_its_own_chunks_only(spark, tmp_path, monkeypatch):
    path, work = str(tmp_path / "i"), []
    write = index._write_segment
    monkeypatch.setattr(index, "_write_segment", lambda chunks, *a: work.append(chunks.count()) or write(chunks, *a))
    for n in range(5):
        index.put_batch(chunks_of(spark, TEXTS[:2], 2 * n), path, n)
    assert work == [2] * 5


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    index.put_batch(chunks_of(spark, TEXTS[:3]), path, 0, "a")
    before = index.manifest(spark, path)
    assert index.put_batch(chunks_of(spark, TEXTS[:3]), path, 0, "a") == before
    # another stream's batch of that number is another batch
    assert index.put_batch(chunks_of(spark, TEXTS[3:5], 3), path, 0, "b").version == before.version + 1
    assert index.load(spark, path)[0].count() == 5


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    path = str(tmp_path / "i")
    index.put_batch(chunks_of(spark, TEXTS[:2]), path, 0)
    chunks, lexical = index.load(spark, path)
    before = answers(spark, lexical)
    index._write_segment(chunks_of(spark, TEXTS), path)  # a writer that has not committed, or never will
    assert index.load(spark, path)[0].count() == 2
    index.put_batch(chunks_of(spark, TEXTS[2:], 2), path, 1)
    index.compact(spark, path, fan_in=2)
    assert chunks.count() == 2 and answers(spark, lexical) == before
    assert index.load(spark, path)[0].count() == len(TEXTS)
    assert index.load(spark, path, 1)[0].count() == 2


def test_vacuum_deletes_what_no_version_names(spark, tmp_path):
    path = str(tmp_path / "i")
    for n in range(3):
        index.put_batch(chunks_of(spark, TEXTS[n : n + 1], n), path, n)
    index.compact(spark, path, fan_in=3)
    index._write_segment(chunks_of(spark, TEXTS), path)
    assert index.vacuum(spark, path, keep=1) == []  # all within the grace
    assert len(index.vacuum(spark, path, keep=1, grace_seconds=-1)) == 4
    assert index.load(spark, path)[0].count() == 3
    with pytest.raises(FileNotFoundError):
        index.load(spark, path, 1)


def test_of_two_writers_one_starts_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index.put_batch(chunks_of(spark, TEXTS[:1]), path, 0)
    with pytest.raises(index.Conflict):
        index.Folder(spark, path).write_new("manifest/v0000000001", json.dumps({}))
    commit, raced = index._commit, []

    def late(s, p, new):
        if not raced:
            raced.append(1)
            index.put_batch(chunks_of(spark, TEXTS[1:2], 1), path, 0, "other")
        return commit(s, p, new)

    monkeypatch.setattr(index, "_commit", late)
    index.put_batch(chunks_of(spark, TEXTS[2:3], 2), path, 1)
    assert index.load(spark, path)[0].count() == 3
    assert index.manifest(spark, path).batches == {"": [0, 1], "other": [0]}


def test_save_replaces_and_an_empty_index_answers_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    index.put_batch(chunks_of(spark, TEXTS), path, 0)
    index.save(chunks_of(spark, ["one two"]), path)
    assert index.load(spark, path)[0].count() == 1
    index.save(chunks_of(spark, ["one"]).limit(0), path)
    chunks, lexical = index.load(spark, path)
    assert chunks.count() == 0 and answers(spark, lexical) == []
