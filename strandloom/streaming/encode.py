"""Encoders on streams: they work row by row, so they keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.encoders import Encoder


def encode_stream(stream: DataFrame, encoder: Encoder, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the features of each arriving sequence (seq_id, seq) to a Parquet table."""
    writer = encoder.transform(stream).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
