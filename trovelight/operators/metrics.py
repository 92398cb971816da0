"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_relevant(results: DataFrame, cases: DataFrame, strategies: list[str]) -> DataFrame:
    """results: (strategy, qid, source, rank), cases: (qid, expected array). Returns (strategy, qid, first_rank): for
    every strategy and case the smallest rank of an expected source, null if there is none."""
    expected = cases.select("qid", F.explode("expected").alias("source")).distinct()
    hits = results.join(expected, ["qid", "source"]).groupBy("strategy", "qid").agg(F.min("rank").alias("first_rank"))
    asked = cases.select("qid", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    return asked.join(hits, ["strategy", "qid"], "left")


def summary(ranks: DataFrame, cuts: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Hit rate at each cut and mean reciprocal rank by strategy, misses as 0."""
    rank = F.col("first_rank")
    hits = [F.round(F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f"hit_{k}") for k in cuts]
    return ranks.groupBy("strategy").agg(*hits, F.round(F.coalesce(F.avg(F.coalesce(1 / rank, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))
