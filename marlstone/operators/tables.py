"""The index's tables as relations: differences, upserts, deletions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(disk: DataFrame, tracked: DataFrame) -> DataFrame:
    """file_path, change (new, changed or deleted): disk (file_path, mtime) against the tracker (file_path, file_mtime).

    Any other time is a change, an older one too. Unchanged files are left out.
    """
    d, t = disk.select("file_path", "mtime", F.lit(True).alias("on_disk")), tracked.select("file_path", "file_mtime", F.lit(True).alias("known"))
    both = d.join(t, "file_path", "full_outer")
    change = F.when(F.col("known").isNull(), "new").when(F.col("on_disk").isNull(), "deleted").when(~F.col("mtime").eqNullSafe(F.col("file_mtime")), "changed")
    return both.select("file_path", change.alias("change")).where("change is not null")


def skip_unchanged(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """files (file_path, content_hash) that are not indexed with that hash."""
    done = tracked.where("is_indexed").select("file_path", "content_hash")
    return files.join(done, ["file_path", "content_hash"], "left_anti")


def stale(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the store that belong to re-indexed files and are not among their new chunks."""
    return existing.join(new.select("file_path").distinct(), "file_path", "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti")


def delete_files(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("file_path").distinct(), "file_path", "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """store with new's rows in place of those of the same key."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def record_errors(tracked: DataFrame, errors: DataFrame) -> DataFrame:
    """The tracker after failures (file_path, error_msg): a known row keeps all but its message, an unknown one is a failure."""
    e = errors.groupBy("file_path").agg(F.max("error_msg").alias("_error"))
    merged = tracked.withColumn("_known", F.lit(True)).join(e, "file_path", "full_outer")
    new = F.col("_known").isNull()
    values = {"file_mtime": F.lit(0.0), "content_hash": F.lit(""), "is_indexed": F.lit(False)}
    return merged.select("file_path", *[F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else (F.coalesce("_error", "error_msg").alias(c) if c == "error_msg" else F.col(c)) for c in tracked.columns if c != "file_path"])


def tracker_stats(tracked: DataFrame) -> DataFrame:
    """total, indexed, failed, pending in one pass."""
    indexed, failed = F.count_if(F.col("is_indexed")), F.count_if(~F.col("is_indexed") & F.col("error_msg").isNotNull())
    return tracked.agg(F.count("*").alias("total"), indexed.alias("indexed"), failed.alias("failed"), (F.count("*") - indexed - failed).alias("pending"))


def by_path(tracked: DataFrame, path: str) -> DataFrame:
    """The tracker's row of one file."""
    return tracked.where(F.col("file_path") == path)


def indexed_files(tracked: DataFrame) -> DataFrame:
    return tracked.where("is_indexed").select("file_path", "file_mtime", "content_hash")


def store_stats(store: DataFrame) -> DataFrame:
    """documents (the store's rows, which are chunks) and files."""
    return store.agg(F.count("*").alias("documents"), F.count_distinct("file_path").alias("files"))


def run_summary(results: DataFrame) -> DataFrame:
    """Of results (status: success, failed or skipped; n_chunks): counts and the success rate in per cent of those tried."""
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return results.agg(ok.alias("success"), bad.alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("n_chunks"))), F.lit(0)).alias("chunks"), F.round(F.coalesce(ok * 100.0 / F.nullif(ok + bad, F.lit(0)), F.lit(0.0)), 6).alias("success_rate"))


def list_documents(store: DataFrame, where, limit: int = 20) -> DataFrame:
    """One row a file (that of its first chunk), at most `limit` clamped to 1..100, and the number of files matched."""
    limit = max(1, min(limit, 100))
    first = store.where(where).withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("chunk_index"))).where("_n = 1").drop("_n")
    total = first.agg(F.count("*")).scalar()
    return first.orderBy("file_path").limit(limit).withColumn("total_matched", total)


def document_page(chunks: DataFrame, path: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """One row: a page of a file's chunks as one text, with totals and where the next page begins."""
    offset, limit = max(0, offset), max(1, min(limit, 50))
    own = chunks.where(F.col("file_path") == path)
    on_page = F.col("chunk_index").between(offset, offset + limit - 1)
    page = F.sort_array(F.collect_list(F.when(on_page, F.struct("chunk_index", "text"))))
    total = F.count("*")
    more = total > offset + limit
    return own.agg(total.alias("total_chunks"), F.sum(F.length("text")).alias("total_chars"), F.array_join(F.transform(page, lambda x: x["text"]), "\n").alias("content"), more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))
