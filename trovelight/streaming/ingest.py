"""Continuous ingest: documents that arrive as files in a folder are chunked, embedded and appended to an index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trovelight.functions.models import Embedder, embed, hashed_embedder
from trovelight.operators.chunking import chunk_documents
from trovelight.sources import index as stored


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, embedder: Embedder = hashed_embedder) -> StreamingQuery:
    """Takes JSON lines of (source, text) that are there or come while it runs, a micro-batch at a time, then stops.

    Chunking and embedding keep no state; a batch becomes a segment of the index, and statistics are summed over segments
    when they are read. A batch that is retried after a failure changes nothing if it was committed, and is written anew if
    it was not. The checkpoint tells this stream's batches from those of others.
    """
    writer = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    docs = spark.readStream.schema("source string, text string").json(folder)

    def append(batch: DataFrame, number: int) -> None:
        chunks = embed(chunk_documents(batch.filter("length(text) > 0")), "text", embedder)
        stored.put_batch(chunks, path, number, writer)

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
