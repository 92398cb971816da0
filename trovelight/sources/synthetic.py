"""Seeded synthetic vectors; each row depends on its id and the seed alone, not on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 0, centres: int = 0, noise: float = 0.7, first: int = 0) -> DataFrame:
    """(id, vector), ids from `first` on: uniform directions, or with `centres` above 0 a random centre plus `noise` times such a direction."""
    middle = [_unit(np.random.default_rng([seed, 1, c]).uniform(-1, 1, dims)) for c in range(centres)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, 0, int(i)])
                v = _unit(rng.uniform(-1, 1, dims))
                rows.append((_unit(middle[rng.integers(centres)] + noise * v) if centres else v).tolist())
            yield pd.DataFrame({"id": batch["id"], "vector": rows})

    return spark.range(first, first + n).mapInPandas(run, "id long, vector array<double>")
