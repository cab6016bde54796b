"""Folders and files as tables: a tree is listed a level a job, and only the files that a table names are opened.

Both run in tasks: what a task lists or opens are the rows it is given, so an exclusion or a join above decides what is touched.
A place is a path that all workers see, or a URI of a store that pyarrow knows (s3, gs, hdfs). A folder or file that cannot
be read is a row with a reason, and stops nothing.
"""

from __future__ import annotations

import io
import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.functions.text import base_name, nfc

ENTRY = "place string, folder boolean, mtime double, length long, error string"
OPENED = "content binary, error string"


def _store(place: str):
    """(file system, path in it) of a URI; None and the path of a plain path."""
    scheme = place.split("://", 1)[0] if "://" in place else ""
    if scheme in ("", "file") or place.startswith("file:/"):
        return None, "/" + place.removeprefix("file:").lstrip("/") if place.startswith("file:") else place
    from pyarrow import fs

    return fs.FileSystem.from_uri(place)


def _time(ns: int) -> float:
    """Seconds, to the millisecond that file systems under Spark report."""
    return ns // 1_000_000 / 1000


def entries(place: str) -> Iterator[tuple]:
    """Rows of ENTRY for what lies in a folder; links to folders are not followed. A file gives itself."""
    store, path = _store(place)
    try:
        if store is None:
            top = os.stat(path)
            if not stat.S_ISDIR(top.st_mode):
                yield place, False, _time(top.st_mtime_ns), top.st_size, None
                return
            with os.scandir(path) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.path, True, None, None, None
                        elif e.is_file():
                            s = e.stat()
                            yield e.path, False, _time(s.st_mtime_ns), s.st_size, None
                    except OSError as x:
                        yield e.path, False, None, None, f"{type(x).__name__}: {x.strerror}"
            return
        from pyarrow import fs

        head = place[: len(place) - len(path)] if place.endswith(path) else place.split("://")[0] + "://"
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        for e in found:
            folder = e.type == fs.FileType.Directory
            yield head + e.path, folder, None if folder or e.mtime_ns is None else _time(e.mtime_ns), None if folder else e.size, None
    except OSError as x:
        yield place, None, None, None, f"{type(x).__name__}: {x.strerror or x}"


def content(place: str, most: int, size: int = 1 << 20) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why there are none; of a file that is larger than `most` by now, no more is read than tells so.

    It is read `size` bytes at a time: a read takes the memory that it is asked for, whatever the file holds.
    """
    store, path = _store(place)
    raw = io.BytesIO()
    try:
        with open(path, "rb") if store is None else store.open_input_stream(path) as f:
            while block := f.read(min(size, most + 1 - raw.tell())):
                raw.write(block)
    except OSError as x:
        return None, f"{type(x).__name__}: {x.strerror or x}"
    return (raw.getvalue(), None) if raw.tell() <= most else (None, f"larger than {most} bytes")


def blocks(place: str, most: int, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, `size` at a time; an OSError once they are more than `most`."""
    store, path = _store(place)
    left = most
    with open(path, "rb") if store is None else store.open_input_stream(path) as f:
        while raw := f.read(size):
            left -= len(raw)
            if left < 0:
                raise TooLarge(f"larger than {most} bytes")
            yield raw


class TooLarge(OSError):
    pass


def listed(folders: DataFrame) -> DataFrame:
    """What lies in each folder of folders (place), one level deep."""

    def run(batches):
        names = [x.split()[0] for x in ENTRY.split(", ")]
        kinds = [pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.string()]
        for batch in batches:
            for place in batch.column(0).to_pylist():
                rows = []
                for row in entries(place):
                    rows.append(row)
                    if len(rows) == 8192:
                        yield _batch(rows, names, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    return folders.select("place").mapInArrow(run, ENTRY)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def walk(spark: SparkSession, root: str, skipped: Callable[[Column], Column] | None = None, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """place, file_path (composed Unicode), mtime, length, error of all files below root (of root itself, if it is a file).

    A folder whose base name `skipped` is true of is never entered, nor listed. A level is a job over the folders that the
    one above found, dealt out evenly; keep() writes each level where executors find it again (by default it is persisted).
    """
    keep = keep or (lambda level, depth: level.persist())
    folders, levels = spark.createDataFrame([(root,)], "place string"), []
    while True:
        level = keep(listed(folders), len(levels))
        levels.append(level.where(~F.coalesce("folder", F.lit(False))).select("place", "mtime", "length", "error"))
        below = level.where("folder").select("place")
        if skipped is not None:
            below = below.where(~skipped(base_name(F.col("place"))))
        n = below.count()
        if not n:
            break
        folders = below.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // 1000)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("place", nfc(F.regexp_replace("place", "^file:/*", "/")).alias("file_path"), "mtime", "length", "error")


def opened(files: DataFrame, most: int, use: Callable[[bytes | None, str | None, str], dict], schema: T.StructType, by: str, hold: int = 1 << 24) -> DataFrame:
    """files (place, ...) with a column `extraction`: use(bytes, why there are none, the column `by`), a row of `schema`.

    Just these files are opened, one at a time; what use() returns leaves in batches of about `hold` characters, and no file's
    bytes leave the task that read them.
    """
    out = T.StructType([*files.schema.fields, T.StructField("extraction", schema)])
    kind = to_arrow_type(schema)
    place, path = files.columns.index("place"), files.columns.index(by)

    def run(batches):
        for batch in batches:
            rows, size, first = [], 0, 0
            for k, (at, name) in enumerate(zip(batch.column(place).to_pylist(), batch.column(path).to_pylist(), strict=True)):
                row = use(*content(at, most), name)
                rows.append(row)
                size += len(row.get("text") or "")
                if size > hold or k + 1 == batch.num_rows:
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=out.names)
                    rows, size, first = [], 0, k + 1

    return files.mapInArrow(run, out)
