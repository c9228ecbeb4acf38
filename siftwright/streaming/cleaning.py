"""Cleaning rows as they arrive with rules fitted on a training table.

The rules hold no state across rows, so a stream needs no watermark and results do not depend on
how the stream is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftwright.operators.prep import PrepModel


def clean_stream(stream: DataFrame, model: PrepModel, keep: tuple[str, ...] = ()) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("clean_stream expects a streaming DataFrame")
    return model.transform(stream, keep)


def write_clean(
    stream: DataFrame, model: PrepModel, path: str, checkpoint: str, keep: tuple[str, ...] = (), once: bool = False
) -> StreamingQuery:
    """Append cleaned rows to a Parquet folder; with `once`, handle what is there and stop."""
    writer = (
        clean_stream(stream, model, keep)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
