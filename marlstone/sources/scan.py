"""Directory scans: which files there are, without reading their contents, and which of them count."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import file_extension
from marlstone.sources import tree

#: The formats, and names that are passed over.
SUPPORTED = ("hwp", "hwpx", "pdf", "docx", "pptx", "xlsx", "xls", "csv", "txt", "md", "html", "htm", "rtf", "pages", "numbers", "key")
EXCLUDED = (r"^\..*", r"^~\$.*", r".*~$", r".*\.tmp$", r".*__pycache__.*", r".*\.git.*", r".*node_modules.*", r"Thumbs\.db", r"desktop\.ini")


def valid_patterns(patterns: tuple[str, ...]) -> list[str]:
    """The patterns that compile; others are warned of and left out."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error as e:
            warnings.warn(f"pattern {p!r} is left out: {e}", stacklevel=2)
    return good


def excluded(name: Column, more: tuple[str, ...] = (), built_in: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a base name matches one of the patterns, anywhere unless it is anchored."""
    patterns = valid_patterns((*built_in, *more))
    return name.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def supported(path: Column, extensions: tuple[str, ...] = SUPPORTED) -> Column:
    return file_extension(path).isin(*extensions)


def select_files(files: DataFrame, root: str = "", more: tuple[str, ...] = (), max_mb: int = 500, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """files (file_path, mtime, length) of a supported format, no larger than max_mb, no part of whose path under root is excluded."""
    below = F.regexp_replace("file_path", "^" + re.escape(root.rstrip("/")) + "/?", "") if root else F.col("file_path")
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    return files.where(supported(F.col("file_path"), extensions) & ~F.exists(parts, lambda p: excluded(p, more)) & (F.col("length") <= max_mb * 1024 * 1024))


def select_files_full(files: DataFrame, patterns: tuple[str, ...] = (), max_mb: int = 100, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """The full index's other rule: patterns on the whole path, none built in."""
    return files.where(supported(F.col("file_path"), extensions) & ~excluded(F.col("file_path"), patterns, ()) & (F.col("length") <= max_mb * 1024 * 1024))


def files(spark: SparkSession, root: str, more: tuple[str, ...] | None = (), keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """file_path (composed Unicode), place, mtime, length of the files under root; no file is opened, and no folder entered whose
    name is excluded (more=None: all are entered). What cannot be read is left out."""
    skipped = None if more is None else lambda name: excluded(name, more)
    found = tree.walk(spark, root, skipped, keep)
    return found.where("error is null").select("file_path", "place", "mtime", "length")


def scan(spark: SparkSession, root: str, more: tuple[str, ...] = (), max_mb: int = 500, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    return select_files(files(spark, root, more, keep), root, more, max_mb)


def once(found: DataFrame) -> DataFrame:
    """One row a file_path: names that composing makes equal are one file, that of the least place."""
    rest = [c for c in found.columns if c != "file_path"]
    return found.groupBy("file_path").agg(F.min(F.struct("place", *[c for c in rest if c != "place"])).alias("f")).select("file_path", *[F.col(f"f.{c}").alias(c) for c in rest])


def even(found: DataFrame, size: int = 1 << 27, most: int = 4096) -> DataFrame:
    """found (length, ...) dealt out so that a task opens about `size` bytes, or `most` files."""
    n, total = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return found.repartition(max(1, -(-n // most), -(-int(total) // size), min(n, found.sparkSession.sparkContext.defaultParallelism)))
