"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.operators.lexical import top_k

OFFSET = 60


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """lists: (qid, id, rank). Returns (qid, id, score, rank): the k largest sums of 1 / (60 + rank).

    Scores are rounded to twelve digits; ties go to what stands first in the first list that holds it.
    """
    numbered = [x.select("qid", "id", "rank").withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)]
    return fuse_numbered(reduce(DataFrame.unionByName, numbered), k)


def fuse_numbered(rows: DataFrame, k: int) -> DataFrame:
    """The same for (qid, id, list_no, rank) rows."""
    merged = rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (OFFSET + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return top_k(merged, k, order=(F.desc("score"), F.col("seen"))).drop("seen")
