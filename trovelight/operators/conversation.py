"""Conversation history: trimming to a token budget and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelight.functions.text import estimate_tokens


def trim_history(turns: DataFrame, budget: int = 800) -> DataFrame:
    """turns: (conv_id, turn, role, text). Drops each conversation's oldest messages until the rest fits."""
    later = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, Window.unboundedFollowing)
    return turns.withColumn("left", F.sum(estimate_tokens(F.col("text"))).over(later)).filter(F.col("left") <= budget).drop("left")


def transcript(turns: DataFrame) -> DataFrame:
    """One row a conversation: its messages in order, each with its speaker."""
    said = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.col("x.said"), "\n").alias("transcript"))
