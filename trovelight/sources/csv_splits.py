"""CSV files of any size to documents: read in Spark's splits, with the state of quotes carried over them by prefix sums.

A line's quotes change the state of what follows by their number alone: odd turns it round, even leaves it. So the state
before each line is the parity of all quotes before it, which is a sum over splits and one within a split. Lines between
which a quote is open are one text; each such text is parsed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovelight.sources.files import parse_csv
from trovelight.sources.scratch import Scratch

_RECORDS = "path string, block long, at long, part int, fields array<string>"


def running(rows: DataFrame, value: str, order: list[str], to: str) -> DataFrame:
    """Adds `to`: the sum of `value` over the rows of the same path before this one. Rows are summed within their block, and
    blocks, of which there are as many as splits, within their path."""
    rows = rows.withColumn(to, F.coalesce(F.sum(value).over(Window.partitionBy("path", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = rows.groupBy("path", "block").agg(F.sum(value).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("path").alias("p"), F.col("block").alias("b"), before.alias("start"))
    joined = rows.join(blocks, (rows["path"] == blocks["p"]) & (rows["block"] == blocks["b"]))
    return joined.withColumn(to, F.col(to) + F.col("start")).drop("p", "b", "start")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, block, at, text in zip(batch["path"], batch["block"], batch["at"], batch["text"], strict=True):
            out += [(path, block, at, part, fields) for part, fields in enumerate(parse_csv(text))]
        yield pd.DataFrame(out, columns=["path", "block", "at", "part", "fields"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, fields): the records of the file or files at path, numbered from 0 in each; records of blank fields only
    do not count. What parse_csv gives for the whole file, but no file is one row; a record that a quote leaves open is."""
    scratch = Scratch(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("size"))
    # written, so that the numbers of lines stay what they are
    lines = scratch.kept(lines.withColumn("quotes", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")), "lines")
    lines = running(lines, "quotes", ["at"], "before")
    opened, closed = F.col("before") % 2 == 1, (F.col("before") + F.col("quotes")) % 2 == 0
    lines = lines.withColumn("first", (~opened).cast("long")).withColumn("whole", ~opened & closed)
    one = lines.filter("whole").select("path", "block", "at", F.col("value").alias("text"))
    # a text's lines have the same number of first lines up to them
    several = running(lines.filter("not whole"), "first", ["at"], "text_no").withColumn("text_no", F.col("text_no") + F.col("first"))
    joined = several.groupBy("path", "text_no").agg(F.min(F.struct("block", "at")).alias("start"), F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("x"), (F.sum("quotes") % 2 == 1).alias("left_open"))
    # a text that is left open holds the newline at the end of its file, if there is one
    ends = lines.groupBy("path").agg((F.sum(F.octet_length("value") + 1) == F.max("size")).alias("ends")).withColumnRenamed("path", "of")
    joined = joined.join(ends, joined["path"] == ends["of"])
    last = F.when(F.col("left_open") & F.col("ends"), "\n").otherwise("")
    joined = joined.select("path", "start.block", "start.at", F.concat(F.array_join("x.value", "\n"), last).alias("text"))
    found = scratch.kept(one.unionByName(joined).mapInPandas(_parse, _RECORDS), "records")
    numbered = running(found.withColumn("one", F.lit(1)), "one", ["at", "part"], "number")
    return numbered.select("path", F.col("number").cast("long").alias("number"), "fields")


def csv_documents_of(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one document for each record after the header, as csv_documents makes them of a whole file: `column:
    value` lines, missing cells empty, surplus ones left out. source is the file's address with :row and the record's number
    from 2 on. A file without a record after its header gives nothing."""
    rows = records(spark, path)
    clean = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    header = rows.filter("number = 0").select(F.col("path").alias("of"), F.transform("fields", clean).alias("header"))
    body = rows.filter("number > 0")
    body = body.join(header, body["path"] == header["of"])
    cells = F.transform("header", lambda h, i: F.concat(h, F.lit(": "), F.coalesce(clean(F.get("fields", i)), F.lit(""))))
    return body.select(F.concat("path", F.lit(":row"), (F.col("number") + 1).cast("string")).alias("source"), F.array_join(cells, "\n").alias("text"))
