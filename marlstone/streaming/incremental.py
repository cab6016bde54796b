"""Indexing from a stream of files, and the tracker's latest state from a stream of changes.

The file source reports new files only; deletions and rewrites need the batch difference (Indexer.incremental).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import nfc
from marlstone.operators import tables
from marlstone.operators.snapshot import Snapshot
from marlstone.plans.indexing import Indexer
from marlstone.sources import scan

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def index_stream(indexer: Indexer, checkpoint: str, glob: str | None = None):
    """A query that indexes files as they come; each micro-batch is one upsert, so a repeated batch changes nothing. A file's
    content is read by the batch that names it, and none of the others'."""

    def apply(batch: DataFrame, _: int) -> None:
        with indexer._stage() as folder:
            plain = F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
            listed = batch.select(nfc(plain).alias("file_path"), plain.alias("place"), (F.unix_micros("modificationTime") / 1_000_000).alias("mtime"), "length")
            listing = indexer._staged(scan.once(scan.select_files(listed, indexer.root, indexer.excluded, indexer.max_mb)), f"{folder}/listing")
            indexer._apply(listing.select("file_path", F.lit("changed").alias("change")), listing, folder, "")

    stream = new_files(indexer.spark, indexer.root, glob).select("path", "modificationTime", "length")
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(changes: DataFrame, target: Snapshot, key: str, order: list, checkpoint: str):
    """Keeps in target, which lies in buckets by the same key, the last row of each key of a stream of changes."""

    def apply(batch: DataFrame, _: int) -> None:
        new = tables.latest(batch, key, order).persist()
        target.change(new, lambda old: tables.latest(old.unionByName(new), key, order))
        new.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed counts and sums by type, with a watermark for late rows."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one with a time zone
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
