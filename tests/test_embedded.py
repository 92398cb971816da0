"""Search over embedded documents: the default embedder, and what is written on the way."""

import hashlib
import re

import numpy as np
from trovelight.functions import models
from trovelight.plans import registry, retriever
from trovelight.sources.scratch import Scratch


def plain(text):
    out = np.zeros(models.DIMS)
    for word in re.split(r"[ \t\n\r\f\v]+", (text or "").lower()):
        if word := word.strip(models.PUNCTUATION):
            digest = hashlib.md5(word.encode()).digest()
            out[int.from_bytes(digest[:4], "big") % models.DIMS] += 1 if digest[4] & 0x80 else -1
    return out / (np.linalg.norm(out) or 1)


def test_embedder_equals_a_loop_over_words(monkeypatch):
    texts = ["Red brick, (red) TOWER.", None, "", " ... !? ", "a\x0bb\tc\r\nd\x1ce\x85f\xa0g h", "Ññ İstanbul ß. 'x' \"y\";", "one two one"]
    for most in (models.MOST_SPOTS, 2):
        monkeypatch.setattr(models, "MOST_SPOTS", most)
        models._spots.clear()
        assert np.array_equal(models.hashed_embedder(texts), np.array([plain(t) for t in texts]))
        assert len(models._spots) <= most
    assert models.hashed_embedder([]).shape == (0, models.DIMS)


def test_postings_are_not_written_again(spark, sf_dir, monkeypatch):
    names, kept = [], Scratch.kept
    monkeypatch.setattr(Scratch, "kept", lambda self, rows, name, by=None: names.append(name) or kept(self, rows, name, by))
    assert registry.hybrid_embedded(spark, sf_dir).count() > 0
    assert "chunks" in names and "postings" not in names


def test_strategies_share_the_lists_of_the_questions(spark, sf_dir, monkeypatch):
    searches = {"exact_knn": 0, "bm25": 0}
    for name in searches:
        search = getattr(retriever, name)
        monkeypatch.setattr(retriever, name, lambda *a, name=name, search=search, **b: searches.update({name: searches[name] + 1}) or search(*a, **b))
    assert registry.eval_strategies(spark, sf_dir).count() == 6
    assert searches == {"exact_knn": 3, "bm25": 2}  # questions, made-up answers, rephrasings; 5 and 4 before
