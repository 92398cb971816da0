"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and driver and executors are one process."""
    context = spark.sparkContext
    if path := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return path
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="trovelight-"))
    return context.getCheckpointDir()


class Scratch:
    """Written tables of one computation: kept() cuts a plan and survives lost executors, drop() deletes all but some."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def kept(self, rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """rows as a Parquet table, in one folder for each value of column `by` if given."""
        path = f"{self.folder}/{len(self.paths)}-{name}"
        (rows.write.partitionBy(by) if by else rows.write).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes the tables written so far but for the last `keep`, if nothing lazy reads them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = self.paths[: len(self.paths) - keep]
        for p in gone:
            if p:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        self.paths[: len(gone)] = [""] * len(gone)
