"""Continuous ingest: micro-batches of documents become batches of an index, and windowed facets of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamdex.index import Index


def deduplicated(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """One document per path within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["path"])


def ingest(stream: DataFrame, index: Index, checkpoint: str, once: bool = False, at: str = "ts") -> StreamingQuery:
    """Write a stream of (path, data_json, and a time of the event) to an index, a batch per trigger.

    Of a path's documents in a batch the one with the latest time stands, ties by the document. The index keeps the number
    of the last batch for each checkpoint, so a batch that is given again changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        seq = F.unix_micros(F.col(at).cast("timestamp")) if at in batch.columns else F.lit(0).cast("long")
        # ties within a path by the document: only the last of a path and time is written
        rows = batch.select(F.coalesce(seq, F.lit(0)).alias("seq"), F.lit("put").alias("op"), "path", "data_json")
        rows = rows.groupBy("seq", "op", "path").agg(F.max("data_json").alias("data_json"))
        index.write_ops(rows, stream=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, field: str, at: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, value, count) of a field over tumbling windows of event time; late rows beyond the watermark are left out."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, size), F.col(field).alias("value")).count()
    return rows.select(F.col("window.start").alias("start"), "value", "count")
