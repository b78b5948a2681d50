"""Scoring of streams: a fitted tree is a projection, so a model's transform works on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model, stream: DataFrame, sink: str, checkpoint: str, path: str | None = None, name: str | None = None) -> StreamingQuery:
    """Starts a query that appends the stream's rows with their predictions to a sink ("parquet", "memory", ...)."""
    writer = model.transform(stream).writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if path:
        writer = writer.option("path", path)
    return (writer.queryName(name) if name else writer).start()
