"""Calls of outside models from Spark tasks: resources that a Python worker makes once, batches, retries, error rows."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Of this process: what has been made, by key.
_made: dict[str, Any] = {}


@dataclass(frozen=True)
class Resource:
    """Something costly, such as a loaded model, that tasks use: sent as the function that makes it, and made when it is
    first used, once in each Python worker however many tasks the worker runs."""

    make: Callable[[], Any]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def get(self) -> Any:
        if self.key not in _made:
            _made[self.key] = self.make()
        return _made[self.key]

    def __call__(self, *args: Any) -> Any:
        return self.get()(*args)


def as_resource(thing: Any) -> Resource:
    """A resource as it is; anything else is sent whole with the tasks, its class too if it comes from a script or another
    module that workers cannot import."""
    if isinstance(thing, Resource):
        return thing
    module = sys.modules.get(type(thing).__module__)
    path = getattr(module, "__file__", None) or ""
    if path and "site-packages" not in path and not module.__name__.startswith(__name__.split(".")[0]):
        cloudpickle.register_pickle_by_value(module)
    return Resource(lambda: thing)


@dataclass(frozen=True)
class Policy:
    """tries: calls of one question at most. wait: seconds before the second, doubled before each further one. at_once:
    calls that one task has open."""

    tries: int = 3
    wait: float = 0.5
    longest_wait: float = 30.0
    at_once: int = 8


def ask_all(questions: DataFrame, model: Any, system: str, prompt: str, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """questions: (qid, text). Asks the model prompt + text for each, in the tasks that hold the questions.

    Returns (qid, text, error, tries), one row a question: the answer, or a null text and what the last try failed with. A
    null question is asked as an empty one. Answers can differ from run to run, so write the result before it is used
    more than once.
    """
    resource = as_resource(model)

    def one(text: str | None) -> tuple[str | None, str | None, int]:
        error = None
        for n in range(1, policy.tries + 1):
            try:
                return resource.get().complete(system, [{"role": "user", "content": prompt + (text or "")}]), None, n
            except Exception as e:  # whatever a model raises belongs to its question's row
                error = f"{type(e).__name__}: {e}"
                if n < policy.tries:
                    time.sleep(min(policy.longest_wait, policy.wait * 2 ** (n - 1)))
        return None, error, policy.tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(policy.at_once) as pool:
            for batch in batches:
                if len(batch):
                    with suppress(Exception):  # made before threads could make it twice; if it cannot be, each row says so
                        resource.get()
                    texts = batch["text"].astype(object).where(batch["text"].notna(), None)
                    text, error, tries = zip(*pool.map(one, texts), strict=True)
                    yield pd.DataFrame({"qid": batch["qid"], "text": text, "error": error, "tries": tries})

    kind = questions.schema["qid"].dataType.simpleString()
    return questions.select("qid", "text").mapInPandas(run, f"qid {kind}, text string, error string, tries int")
