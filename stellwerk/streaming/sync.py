"""Continuous sync of new run files into the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stellwerk.operators.sync import new_postings
from stellwerk.sources.runs import run_table_schema
from stellwerk.sources.sinks import append_master, read_master


def read_run_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New run files (JSON lines, by run) as a stream."""
    reader = spark.readStream.schema(run_table_schema())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def start_sync(
    stream: DataFrame, master_path: str, checkpoint: str, available_now: bool = False, interval: str = "1 minute"
) -> StreamingQuery:
    """Append postings with links the master does not hold yet.

    Each micro-batch is the batch sync, so a posting enters once however often its link
    returns. A batch repeated after a failure finds its links in the master and adds
    nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        master = read_master(batch.sparkSession, master_path)
        append_master(new_postings(batch, master), master_path)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def first_within(stream: DataFrame, scraped_at: str, delay: str) -> DataFrame:
    """Bounded-state variant: first posting per link within ``delay`` of event time.

    A link that returns after the watermark has passed is emitted again.
    """
    linked = stream.where(F.coalesce(F.col("link"), F.lit("")) != "")
    return linked.withWatermark(scraped_at, delay).dropDuplicatesWithinWatermark(["link"])
