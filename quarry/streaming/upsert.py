"""A stream of chunks into the store: each micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.store import ChunkStore


def upsert_stream(chunks: DataFrame, store: ChunkStore, source: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Starts the query. Of rows with one id in a batch the last by ``order`` counts; a batch that comes again changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        if df.take(1):  # before rows are dealt out
            store.upsert(df, source, order=order)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
