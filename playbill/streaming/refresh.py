"""The job as a stream: landed pages arrive as files, each batch refreshes the venues that it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..sources.keyed import KeyedTable
from .state import changed_pages, with_state_store


def latest(pages: DataFrame) -> DataFrame:
    """The latest landing of each page that worked."""
    good = pages.where("status = 200 and body <> ''")
    newest = good.groupBy("source", "url").agg(F.max_by(F.struct("fetched_at", "status", "body"), "fetched_at").alias("p"))
    return newest.select("source", "url", "p.fetched_at", "p.status", "p.body")


def pages_table(spark: SparkSession, path: str) -> KeyedTable:
    """The newest page of every address, by source and bucket of addresses."""
    return KeyedTable(spark, path, model.LANDING, ["source", "url"], lead=("source",))


def listen(spark: SparkSession, path: str, state: str, checkpoint: str, refresh: Callable[[DataFrame, int], None], every: int = 20):
    """Start the stream: `refresh(landing, batch)` gets the newest pages of the sources that the batch has changed.

    A batch passes on the pages that differ from what the stream has seen; these are a delta of the table of pages at `state`,
    and of the table only the folders of changed sources are read. So the work of a batch grows with what it brings and with
    the sources that this touches. A batch that is run again puts nothing twice. Deltas are put together `every` so many batches.
    """
    with_state_store(spark)
    table = pages_table(spark, state)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select("source").distinct().collect()]  # sources are venues and catalogues: some tens
            if touched:
                table.put(batch, "stream", number)
                if number % every == every - 1:
                    table.compact()
                    table.tidy()
                refresh(table.read(F.col("source").isin(touched)), number)
        finally:
            batch.unpersist()

    arriving = spark.readStream.schema(model.LANDING).parquet(path)
    return changed_pages(arriving).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
