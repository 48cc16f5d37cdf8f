"""Imports as a stream: each new file of instances is added once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.stores import new_rows


def import_stream(spark: SparkSession, incoming: str, schema: str, stored: str, checkpoint: str, identity: str = "global_id", order: str = "id") -> StreamingQuery:
    """Append rows of new Parquet files under ``incoming`` whose identity isn't stored yet to the table at ``stored``.

    It handles what is there and ends. A batch that is delivered again after a failure adds nothing: its identities are stored by then.
    """

    def add(batch: DataFrame, _: int) -> None:
        try:
            known = spark.read.schema(schema).parquet(stored)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # any other failure must not pass for an empty store
                raise
            known = batch.limit(0)
        new_rows(batch, known, identity, order).write.mode("append").parquet(stored)

    return spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window of time, rows later than ``late`` dropped by the watermark; for a stream or a table."""
    from pyspark.sql import functions as F

    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), kind).count().select(F.col("w.start").alias("start"), kind, "count")
