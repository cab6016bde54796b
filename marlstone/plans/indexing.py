"""Indexing: difference, extraction, chunks, metadata, prefix, vectors, upsert, clean-up, tracking.

A run lists the tree without the folders that are excluded, and opens the files that the difference names and no others. What it
reads is staged once as a table; a file that fails is a row. The store changes in one step at the end, in the
buckets of changed files alone, so a failed run leaves the last state. The keyword index gets one segment of what came and went.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.functions.text import chunk_id, content_hash
from marlstone.operators import chunk, embed, metadata, tables
from marlstone.operators.snapshot import Snapshot, Version
from marlstone.session import no_shuffle_kept
from marlstone.sources import extract, scan


@dataclass
class Indexer:
    spark: SparkSession
    root: str
    home: str
    embedder: embed.Embedder
    chunk_size: int = 800
    overlap: int = 100
    prefix: bool = True
    max_mb: int = 100
    excluded: tuple[str, ...] = ()
    batch_size: int = 64
    buckets: int = 256
    readers: dict | None = None  # extract.readers(...): an engine for images, other formats
    on_change: Callable[[Version, Version, DataFrame, DataFrame], None] | None = None  # (before, after, chunks that came, chunks that went)

    def __post_init__(self):
        self.store = Snapshot(self.spark, f"{self.home}/chunks", schema.CHUNK, buckets=self.buckets)
        self.tracker = Snapshot(self.spark, f"{self.home}/tracker", schema.TRACKER, buckets=self.buckets)

    def listing(self, folder: str) -> DataFrame:
        """The files that count, off the tree as it is now; the levels of the walk lie in `folder`."""
        return scan.once(scan.scan(self.spark, self.root, self.excluded, self.max_mb, lambda level, depth: self._staged(level, f"{folder}/level-{depth}")))

    def changes(self, listing: DataFrame | None = None) -> DataFrame:
        """file_path, change of what differs between the folder and the tracker."""
        found = scan.once(scan.scan(self.spark, self.root, self.excluded, self.max_mb)) if listing is None else listing
        return tables.snapshot_diff(found, self.tracker.read())

    def pending(self) -> dict[str, int]:
        with self._stage() as folder:
            return {r["change"]: r["count"] for r in self.changes(self.listing(folder)).groupBy("change").count().collect()}

    def incremental(self, now: str = "") -> DataFrame:
        """Indexes new and changed files, drops deleted ones; the run's summary."""
        with self._stage() as folder:
            listing = self._staged(self.listing(folder), f"{folder}/listing")
            return self._apply(self.changes(listing), listing, folder, now)

    def full(self, now: str = "", patterns: tuple[str, ...] = ()) -> DataFrame:
        """Indexes whatever is not indexed with its present hash; it deletes nothing."""
        with self._stage() as folder:
            found = scan.files(self.spark, self.root, None, lambda level, depth: self._staged(level, f"{folder}/level-{depth}"))
            files = self._staged(scan.once(scan.select_files_full(found, patterns, self.max_mb)), f"{folder}/listing")
            wanted = tables.skip_unchanged(files.withColumn("content_hash", content_hash(F.col("file_path"), F.col("mtime"))), self.tracker.read())
            known = self.tracker.read().select("file_path", F.lit(True).alias("known"))
            changes = wanted.join(known, "file_path", "left").select("file_path", F.when(F.col("known"), "changed").otherwise("new").alias("change"))
            return self._apply(changes, files, folder, now, files.count() - wanted.count())

    def build(self, changes: DataFrame, listing: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """(chunks, results) of the new and changed files, off tables in `folder`; only these files are opened, in one job."""
        wanted = scan.even(listing.join(changes.where("change <> 'deleted'"), "file_path", "left_semi"))
        # small row groups, so that a large file's chunks are many tasks' work from here on
        read = self._staged(extract.chunk_files(wanted, self.chunk_size, self.overlap, self.readers, self.max_mb), f"{folder}/read", 8 << 20)
        files = self._staged(read.where("chunk_index is null").drop("chunk_index", "chunk_text"), f"{folder}/files")
        good = metadata.file_metadata(files.where("success"), root=self.root).drop("mtime", "length", "success", "error", "first_chunk", "properties")
        rows = read.where("chunk_index is not null").select("file_path", "chunk_index", "chunk_text").join(good, "file_path")
        text = F.col("chunk_text")
        if self.prefix:
            text = F.concat(metadata.context_prefix(*[F.col(c) for c in ("doc_title", "doc_author", "doc_created", "fs_modified", "file_name", "relative_path")]), text)
        rows = rows.withColumn("text", text).where(chunk.not_blank(F.col("text")))
        rows = rows.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("chunk_index"))).withColumn("embedding", embed.embedded(F.col("text"), self.embedder, self.batch_size))
        return rows.select(*[f.name for f in schema.CHUNK.fields]), files.select("file_path", "mtime", "success", "error")

    def _apply(self, changes: DataFrame, listing: DataFrame, folder: str, now: str, skipped: int = 0) -> DataFrame:
        changes = self._staged(changes, f"{folder}/changes")
        chunks, results = self.build(changes, listing, folder)
        gone, done = changes.where("change = 'deleted'").select("file_path"), results.where("success").select("file_path")
        over = gone.union(done)  # a re-indexed file's chunks go whole, stale ones with them
        made = self.store.change(changes, lambda old: tables.delete_files(old, over).unionByName(chunks))
        if made is not None:
            self._delete(f"{folder}/read")  # it is stored
            touched, (before, after) = self.store.buckets_of(changes), made
            chunks = self.store.read(touched, after).join(done, "file_path", "left_semi")  # as stored: made once
            if self.on_change:
                self.on_change(before, after, chunks, self.store.read(touched, before).join(over, "file_path", "left_semi"))
        rows = results.where("success").select("file_path", F.col("mtime").alias("file_mtime"), content_hash(F.col("file_path"), F.col("mtime")).alias("content_hash"), F.lit(now).alias("last_indexed"), F.lit(True).alias("is_indexed"), F.lit(None).cast("string").alias("error_msg"), F.lit(self.embedder.name).alias("embedding_model"))
        failed = results.where("not success").select("file_path", F.col("error").alias("error_msg"))
        self.tracker.change(changes, lambda old: tables.record_errors(tables.upsert(tables.delete_files(old, gone), rows, "file_path"), failed))
        counted = chunks.groupBy("file_path").agg(F.count("*").alias("n_chunks"))
        outcome = results.select("file_path", F.when(F.col("success"), "success").otherwise("failed").alias("status")).join(counted, "file_path", "left")
        if skipped:
            outcome = outcome.unionByName(self.spark.range(skipped).select(F.lit(None).cast("string").alias("file_path"), F.lit("skipped").alias("status"), F.lit(None).cast("long").alias("n_chunks")))
        summary = tables.run_summary(outcome)
        return self.spark.createDataFrame([summary.first()], summary.schema)

    def _staged(self, df: DataFrame, path: str, block: int = 128 << 20) -> DataFrame:
        df.write.option("parquet.block.size", block).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def _stage(self) -> Iterator[str]:
        """A folder for a run's tables, which goes with the run; a shuffle's files go with the job that made them."""
        folder = f"{self.home}/runs/{uuid.uuid4().hex}"
        try:
            with no_shuffle_kept(self.spark):
                yield folder
        finally:
            self._delete(folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
