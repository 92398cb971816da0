"""Choosing, ordering and writing out the context of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelight.functions.text import estimate_tokens


def within_budget(ranked: DataFrame, budget: int = 1800, query: str = "qid") -> DataFrame:
    """ranked: (qid, id, rank, text). Walks each query's list best first and keeps what still fits, skipping what
    does not. A list is folded in one row, so lists must be ranked results of a bounded length."""
    items = F.sort_array(F.collect_list(F.struct("rank", "id", estimate_tokens(F.col("text")).alias("cost"))))
    lists = ranked.groupBy(query).agg(items.alias("items"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.slice("items", 1, 0).alias("kept"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)

    kept = lists.select(query, F.explode(F.aggregate("items", none, step, lambda s: s["kept"])).alias("x"))
    return kept.select(query, F.col("x.id").alias("id"), F.col("x.rank").alias("rank"), F.col("x.cost").alias("cost"))


def context_order(kept: DataFrame, query: str = "qid") -> DataFrame:
    """Adds `position`: best items at both ends, the weakest in the middle."""
    w = Window.partitionBy(query)
    i = F.row_number().over(w.orderBy("rank", "id")) - 1
    n = F.count("*").over(w)
    return kept.withColumn("i", i).withColumn("n", n).withColumn("position", F.expr("cast(if(i % 2 = 0, i div 2, n - 1 - (i - 1) div 2) + 1 as int)")).drop("i", "n")


def context_prompt(ordered: DataFrame, query: str = "qid") -> DataFrame:
    """ordered: (qid, id, position, text). One row a query: numbered blocks with their sources."""
    block = F.concat(F.lit("["), F.col("position"), F.lit("] (source: "), F.col("id"), F.lit(")\n"), F.col("text"))
    rows = ordered.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("position", block.alias("block"), F.col("id").cast("string").alias("id")))).alias("x"))
    return rows.select(query, F.array_join(F.col("x.block"), "\n\n---\n\n").alias("context"), F.col("x.id").alias("ids"))
