"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only; all arithmetic is on integers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm import shared as S

#: Rows of a leaf that are put in order together.
RUN_ROWS = 4096
LEAF = ["domain", "lang", "source"]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: Mapping[str, int], default: int) -> Column:
    if any(w < 0 for w in weights.values()) or default < 0:
        raise ValueError("weights must not be negative")
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(table[F.col(name)], F.lit(default)).cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Splits `budget` (the parent's, on each child's row) by `weight`, no child above `supply`; what a child cannot
    use goes to its siblings by weight. Adds `share`.

    Children fill up in the order of supply / weight; the first that does not fill fixes the level for the rest.
    """
    w = Window.partitionBy(*parent)
    order = w.orderBy(F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).asc_nulls_last(), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    out = children.withColumn("left_tokens", F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(rest)).withColumn("place", F.row_number().over(order))
    full = (F.col("weight") > 0) & (F.col("supply") * F.col("left_weight") <= F.col("weight") * F.col("left_tokens"))
    out = out.withColumn("full", full)
    level = F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct("place", "left_tokens", "left_weight"))).over(w)
    out = out.withColumn("level", level)
    part = F.when(F.col("weight") == 0, F.lit(0)).when(F.col("full"), F.col("supply")).otherwise(F.expr("level.left_tokens * weight div level.left_weight"))
    return out.withColumn("share", F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)).cast("long")).drop("left_tokens", "left_weight", "place", "full", "level")


def budgets(leaves: DataFrame, target_percent: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int], default_weight: int, max_epochs: int) -> DataFrame:
    """Token budget of each leaf. A shortage is made up by siblings first; only what a whole subtree lacks moves up."""
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs).withColumn("source_weight", _weight("source", source_weights, default_weight)).withColumn("lang_weight", _weight("lang", lang_weights, default_weight)).withColumn("domain_weight", _weight("domain", domain_weights, default_weight))
    reachable = lambda name: F.sum(F.when(F.col(f"{name}_weight") > 0, F.col("supply")).otherwise(0))  # noqa: E731  a leaf of weight 0 supplies nothing
    langs = leaves.groupBy("domain", "lang", "lang_weight", "domain_weight").agg(reachable("source").alias("supply"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain", "domain_weight").agg(reachable("lang").alias("supply"), F.sum("tokens").alias("tokens"))
    total = domains.agg(F.sum("tokens").alias("all"))
    top = domains.join(F.broadcast(total)).withColumn("budget", F.expr(f"all * {int(target_percent)} div 100")).withColumnRenamed("domain_weight", "weight")
    top = share_out(top, [], "domain").select("domain", F.col("share").alias("budget"))
    mid = share_out(langs.withColumnRenamed("lang_weight", "weight").join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    return share_out(leaves.withColumnRenamed("source_weight", "weight").join(mid, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "docs", F.col("share").alias("budget"))


def mix_sources(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", target_percent: int = 50, domain_weights: Mapping[str, int] = {}, lang_weights: Mapping[str, int] = {}, source_weights: Mapping[str, int] = {}, default_weight: int = 1, max_epochs: int = 2, seed: int = 0) -> DataFrame:  # noqa: B006
    """How many copies of each document a mixture of `target_percent` of all tokens takes.

    Integer weights go down the tree domain - language - source (share_out). A leaf takes whole epochs while its
    budget lasts, and of the next epoch, in that epoch's seeded order, the longest prefix of documents within what is
    left. The order is by md5 of seed, epoch and id; a leaf is cut into runs of about RUN_ROWS rows by that hash, so
    that no leaf is put in order in one task.

    Returns doc_id, domain, lang, source, n_tokens, leaf_budget and copies (0: not taken), one row per input row.
    Null domain, language or source counts as ''. Null and empty texts have no tokens and never fill a budget.
    Repeated rows each count. An empty table gives no rows; a weight of 0 takes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens(F.col(text_col).cast("string")).alias("n_tokens"))
    # texts are read and counted once
    rows = S.written(rows, "counted")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = budgets(leaves, target_percent, domain_weights, lang_weights, source_weights, default_weight, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("left_over", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("runs", F.expr(f"docs div {RUN_ROWS} + 1"))
    placed = rows.join(plan, LEAF).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("k").cast("string"), F.lit("")))))
    placed = placed.withColumn("run", F.expr("cast(conv(substr(h, 1, 8), 16, 10) as bigint) * runs div 4294967296"))
    run = [*LEAF, "run"]
    placed = placed.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*run).orderBy("h", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy(*run).agg(F.sum("n_tokens").alias("run_tokens"))
    starts = sums.withColumn("start", F.coalesce(F.sum("run_tokens").over(Window.partitionBy(*LEAF).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("run_tokens")
    taken = placed.join(starts, run).withColumn("copies", F.col("epochs") + F.when((F.col("start") + F.col("upto") <= F.col("left_over")) & (F.col("left_over") > 0), 1).otherwise(0))
    return taken.select(F.col("k").alias(id_col), "domain", F.col("lang").alias(lang_col), F.col("source").alias(source_col), "n_tokens", F.col("budget").alias("leaf_budget"), F.col("copies").cast("long").alias("copies"))
