"""Pluggable models: embedders, pair scorers and language models, with offline defaults that need no weights."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions.text import sigmoid, tokenize

#: Texts to vectors of unit length, one row each.
Embedder = Callable[[list[str]], np.ndarray]
#: (questions, texts) to logits.
PairScorer = Callable[[list[str], list[str]], np.ndarray]
DIMS, EMBED_BATCH, SCORE_BATCH = 384, 32, 8
PUNCTUATION = ".,;:!?()[]\"'"
#: Words that a worker remembers, of some hundred bytes each.
MOST_SPOTS = 1 << 19


class LanguageModel(Protocol):
    def complete(self, system: str, messages: list[dict[str, str]]) -> str: ...

    def available(self) -> bool: ...


class _Spots(dict[bytes, int]):
    """Words as they stand in a text, each with twice its dimension, plus one if it counts up; -1 without a letter or
    number. Filled as words come, and begun anew at MOST_SPOTS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_SPOTS:
            self.clear()
        token = word.strip(PUNCTUATION.encode())
        digest = hashlib.md5(token).digest()
        self[word] = spot = 2 * (int.from_bytes(digest[:4], "big") % DIMS) + (digest[4] >> 7) if token else -1
        return spot


_spots = _Spots()


def hashed_embedder(texts: list[str]) -> np.ndarray:
    """Signed hashed bag of words, each worked out once a worker: a stand-in that only knows shared words."""
    words = [(text or "").lower().encode("utf-8", "replace").split() for text in texts]  # bytes split at ASCII whitespace only
    size = list(map(len, words))
    spot = np.fromiter(map(_spots.__getitem__, chain.from_iterable(words)), np.int64, sum(size))
    cell = (np.repeat(np.arange(len(texts)), size) * DIMS + spot // 2)[spot >= 0]
    out = np.bincount(cell, (spot[spot >= 0] & 1) * 2.0 - 1, len(texts) * DIMS).reshape(-1, DIMS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(rows: DataFrame, text_col: str = "text", embedder: Embedder = hashed_embedder) -> DataFrame:
    """Adds `vector`. The embedder is set up once a Python worker and takes EMBED_BATCH texts at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [embedder(texts.iloc[i : i + EMBED_BATCH].fillna("").tolist()) for i in range(0, len(texts), EMBED_BATCH)]
            yield pd.Series([v for p in parts for v in np.asarray(p, np.float32)], dtype=object)

    return rows.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text_col)))


def overlap_logit(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text holds, as a logit from -2 to 2."""
    asked = F.array_distinct(tokenize(question))
    return 4 * F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokenize(text))), F.size(asked)), F.lit(0.0)) - 2


def pair_score(question: Column, text: Column, scorer: PairScorer | None = None) -> Column:
    """Relevance from 0 to 1; the default scorer is overlap_logit, on the JVM."""
    if scorer is None:
        return sigmoid(overlap_logit(question, text))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            parts = [scorer(q.iloc[i : i + SCORE_BATCH].tolist(), t.iloc[i : i + SCORE_BATCH].tolist()) for i in range(0, len(q), SCORE_BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return sigmoid(F.pandas_udf(run, "double")(question, text))


def stream_content(ndjson: Column) -> Column:
    """The message content of stored NDJSON chunks; a last line without a newline is not complete and not read."""
    lines = F.split(ndjson, "\n")
    whole = F.filter(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(whole, lambda x: F.coalesce(F.get_json_object(x, "$.message.content"), F.lit(""))), "")


class NdjsonReader:
    """Message contents of NDJSON that comes in pieces cut at any byte. `tail` is what follows the last newline; it is read
    once its own newline comes. Blank lines are passed over; a line without content, or that is no JSON, has content ''."""

    def __init__(self, tail: bytes = b""):
        self.tail = tail

    def feed(self, piece: bytes) -> list[str]:
        *lines, self.tail = (self.tail + piece).split(b"\n")
        return [self.content(line) for line in lines if line.strip()]

    @staticmethod
    def content(line: bytes) -> str:
        try:
            found = json.loads(line)
        except ValueError:
            return ""
        message = found.get("message") if isinstance(found, dict) else None
        content = message.get("content") if isinstance(message, dict) else None
        return content if isinstance(content, str) else ""


class ModelError(RuntimeError):
    """An endpoint that cannot be reached or refuses; the text says what to do."""


class HttpModel:
    """A chat endpoint that answers POST /api/chat."""

    def __init__(self, url: str | None = None, model: str | None = None, timeout: float = 120):
        self.url = url or os.environ.get("OLLAMA_URL", "http://localhost:11434")
        self.model = model or os.environ.get("OLLAMA_MODEL", "llama3.2")
        self.timeout = timeout

    def _post(self, system: str, messages: list[dict[str, str]], stream: bool):
        body = {"model": self.model, "stream": stream, "messages": [{"role": "system", "content": system}, *messages]}
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            hint = f"; is the model {self.model} installed there?" if e.code == 404 else ""
            raise ModelError(f"{self.url} answered {e.code}{hint}") from e
        except OSError as e:
            raise ModelError(f"{self.url} cannot be reached; is the server running?") from e

    def complete(self, system: str, messages: list[dict[str, str]]) -> str:
        with self._post(system, messages, False) as r:
            return (json.load(r).get("message") or {}).get("content") or ""

    def stream(self, system: str, messages: list[dict[str, str]]) -> Iterator[str]:
        """The answer's parts as they come."""
        reader = NdjsonReader()
        with self._post(system, messages, True) as r:
            while piece := r.read1(8192):
                yield from filter(None, reader.feed(piece))

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/version", timeout=1.5):
                return True
        except OSError:
            return False
