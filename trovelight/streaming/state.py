"""Set-up that the keyed-state operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which transformWithState needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what a streaming DataFrame makes of all input that is there to a Parquet table, and returns the table.

    The file sink commits whole batches, so that one which is retried after a failure appears once.
    """
    spark = rows.sparkSession
    with state_on_disk(spark):
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
