"""Landed pages as a stream: each micro-batch of completed pages is merged into the event table.

An extension of the batch plan for sources that land pages all the time. The file source remembers what it has read, and
merging the same pages again changes nothing, so a batch may be repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import present
from ..plans import silver
from ..plans.pipeline import merge_events
from ..sources import landing
from ..storage import discard, materialise


def page_stream(spark: SparkSession, root: str) -> DataFrame:
    """(folder, page, document) of page files as they land."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json")
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, r"/page_(\d{4,})\.json$", 1)
    return reader.load(root).select(F.regexp_extract(path, r"(.*)/[^/]+$", 1).alias("folder"), number.cast("int").alias("page"), F.col("value").alias("document"))


def merge_batch(root: str, events_path: str, source: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = landing.completed_runs(spark, root).select("run_id", "folder")
        # a run's earlier pages may have come in an earlier batch: all pages of runs that this batch completes or touches
        touched = present(done, batch.select(F.regexp_extract("folder", r"run_([^/]+)$", 1).alias("run_id")).distinct(), ["run_id"])
        if touched.isEmpty():
            return
        pages = landing.pages_of(spark, root, touched)
        new = materialise(silver.accepted(silver.read_tracks(silver.flatten(pages)), source).drop("track"), "stream")
        merge_events(spark, events_path, new)
        discard(new)

    return run


def stream_events(spark: SparkSession, root: str, events_path: str, checkpoint: str, source: str = "provider"):
    """Start the stream over everything that is there now, then stop (available-now trigger). Returns the query."""
    writer = page_stream(spark, root).writeStream.foreachBatch(merge_batch(root, events_path, source))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
