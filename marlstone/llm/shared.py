"""What the operators of this subpackage share: work tables, folds, training samples, Arrow plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import work_dir

from .textbytes import row_slices, utf8_column

#: The folder of all work tables, in the one that the session shares.
WORK = "marlstone-work"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{WORK}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and ids made by the plan are fixed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def remove(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_marlstone_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all work tables of all sessions that share the folder: for when no DataFrame of an operator is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/{WORK}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores in front until no column (in any case) has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def sample_ids(df: DataFrame, stratum: Column, salt: int, cells: int, hashed: Column) -> DataFrame:
    """Of each stratum at most `cells` rows' hashes: the least hash of each of so many cells.

    It reads narrow columns only, combines before the shuffle, and no task sees more than cells x strata rows.
    """
    return (
        df.select(stratum.alias("_s"), hashed.alias("_h"))
        .groupBy("_s", F.pmod(F.xxhash64("_h", F.lit(salt)), F.lit(cells)).alias("_c"))
        .agg(F.min("_h").alias("_h"))
        .select("_h")
        .distinct()
    )


def sample_rows(df: DataFrame, key: list[str], stratum: Column, cells: int, max_chars: int, columns: list[str], text_col: str = "text", salt: int = 7, ids_of: DataFrame | None = None) -> list:
    """A bounded, deterministic sample as rows on the driver: at most `cells` a stratum; of a text of more than
    max_chars characters the passage of so many that the key's hash points to.

    The rows are chosen by the key alone (of `ids_of`, if given, a table with the key), so that no text moves but theirs.
    """
    hashed = F.xxhash64(*[F.col(k) for k in key])
    ids = [r[0] for r in sample_ids(df if ids_of is None else ids_of, stratum, salt, cells, hashed).collect()]
    if not ids:
        return []
    chosen = F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], "_h long"))
    length = F.length(text_col)
    passage = F.when(length <= max_chars, F.col(text_col)).otherwise(F.substring(text_col, (F.pmod(F.col("_h"), length - max_chars + 1) + 1).cast("int"), F.lit(max_chars)))
    found = df.withColumn("_h", hashed).where(F.col(text_col).isNotNull()).join(chosen, "_h", "left_semi").withColumn(text_col, passage)
    first = F.min(F.struct(*columns)) if len(columns) > 1 else F.min(columns[0])
    rows = found.groupBy("_h").agg(first.alias("_r")).collect()
    return [r["_r"] if len(columns) > 1 else {columns[0]: r["_r"]} for r in sorted(rows, key=lambda r: r["_h"])]


def commonest(counts: DataFrame, most: int):
    """Of counts(h, c) the hashes and counts of at most `most` commonest ones, by hash; and the others.

    The least count comes from a histogram of steps of an eighth of an octave: a sort's top rows would meet in one task.
    """
    step = F.floor(F.log2("c") * 8)
    least, room = None, most
    for k, n in sorted(((r["k"], r["n"]) for r in counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        least, room = k, room - n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    table = counts.where(step >= least).toArrow()
    h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], counts.where(step < least)


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of at most 16 MB, unless the session has a bound of its own: long texts come in small batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, size)


def release() -> None:
    """Gives freed memory back to the system; a Python worker outlives its tasks, and otherwise keeps its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def kernel_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list]], keep: list[str] | None = None, max_bytes: int = 1 << 21) -> DataFrame:
    """df's `keep` columns (all by default) and `fields`, which the kernel computes of whole texts in slices of rows.

    make() runs once a task and gives the kernel; the kernel gets (bytes, offsets, nulls) of a slice of about
    max_bytes (a longer text is a slice of its own) and gives one Arrow or numpy array a field.
    """
    bounded_batches(df.sparkSession)
    keep = list(df.columns) if keep is None else keep
    source = df.select(*[df[c] for c in keep], df[text_col].alias(fresh("_text", keep)))
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        kernel = make()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = utf8_column(column)
            nulls = np.asarray(column.is_null())
            for i, j in row_slices(offsets, max_bytes):
                made = kernel(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], nulls[i:j])
                arrays = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                arrays += [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, kind) for a, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            release()

    return source.mapInArrow(run, schema)


def kernel_rows(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable], max_bytes: int = 1 << 21) -> DataFrame:
    """Rows that a task makes of all its texts: the kernel takes slices as above; its finish() gives record batches."""

    def run(batches):
        kernel = make()
        for batch in batches:
            column = batch.column(0)
            data, offsets = utf8_column(column)
            nulls = np.asarray(column.is_null())
            for i, j in row_slices(offsets, max_bytes):
                yield from kernel.take(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], nulls[i:j]) or ()
            release()
        yield from kernel.finish()
        release()

    bounded_batches(df.sparkSession)
    return df.select(text_col).mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of flat values and the lengths of its lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values, kind))
