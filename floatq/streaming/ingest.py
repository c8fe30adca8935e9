"""Bounded-memory ingestion: a stream of (row_id, value) becomes containers, one for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from floatq.sources.chunkstore import ChunkStore, encoded
from floatq.sources.container import CHUNK_ROWS, write_column


def ingest(stream: DataFrame, folder: str, checkpoint: str, codec: str = "zstd", rows: int = CHUNK_ROWS, **options: int) -> StreamingQuery:
    """Start writing; batch n overwrites ``folder``/batch-n, so a repeated batch leaves one copy."""

    def write(batch: DataFrame, n: int) -> None:
        write_column(batch, f"{folder}/batch-{n:09d}", codec, rows, **options)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_store(stream: DataFrame, path: str, checkpoint: str, codec: str = "zstd", rows: int = CHUNK_ROWS, **options: int) -> StreamingQuery:
    """Start adding a stream of (row_id, value) to a store of its own; batch n is generation n, so a repeated batch leaves one copy.

    A chunk holds rows of one batch, however many of its range came in it.
    """

    def write(batch: DataFrame, n: int) -> None:
        ChunkStore(batch.sparkSession, path).put(encoded(batch, codec, rows, **options), n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
