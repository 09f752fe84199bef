"""Streams of documents into the keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecframe.sources.index import SearchIndex


def ingest(stream: DataFrame, index: SearchIndex, checkpoint: str, ttl: float | None = None, available_now: bool = True) -> StreamingQuery:
    """Upsert every micro-batch of a stream with a ``_key`` column into an index. A repeated batch changes nothing more."""
    writer = stream.writeStream.foreachBatch(lambda rows, _: index.load_frame(rows, ttl=ttl)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
