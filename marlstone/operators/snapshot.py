"""Tables that change: rows lie in buckets by key, and numbered manifests name the folder of each bucket.

A change writes new folders for the buckets it touches, however large the rest is, and then publishes the next manifest, which
only one writer can: the number is taken or it is not. A writer that comes second keeps its work if the other one touched
other buckets, and does it again on the new state otherwise; no update is lost. Nothing that a manifest names is ever written
again, so a DataFrame shows the state that it was made of. Folders go by vacuum(), once no manifest younger than the retention and no
lease names them.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]
    touched: list[str] | None  # None: all
    time: float


EMPTY = Version(0, {}, None, 0.0)


class Conflict(RuntimeError):
    """Other writers were faster too often."""


class Folder:
    """Small files of a shared folder, through the file system that Spark reads it with."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jpath = path, spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._is_local = self._fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self._jpath(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[tuple[str, float]]:
        """Names and times (seconds) of what lies in a folder of this one; those that begin with a dot don't count."""
        try:
            found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._at(name))]
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise
        return [(n, t) for n, t in found if not n.startswith(".")]

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, name: str, value: dict, replace: bool = True) -> None:
        stream = self._fs.create(self._at(name), replace)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Writes a file unless there is one of that name, in one step: of several writers one gets True."""
        if self._is_local:  # whose create() looks first and writes then; a link is one step
            parent, _, last = name.rpartition("/")
            draft = f"{parent}/.{uuid.uuid4().hex}-{last}".lstrip("/")
            self.put(draft, value)
            own = self._jpath(self.path).toUri().getPath()
            try:
                os.link(f"{own}/{draft}", f"{own}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                self.delete(draft)
        try:
            self.put(name, value, False)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "file_path", buckets: int = 256, retention: float = 3600.0, attempts: int = 8):
        self.spark, self.path, self.schema, self.key, self.buckets, self.retention, self.attempts = spark, path.rstrip("/"), schema, key, buckets, retention, attempts
        self.retries = 0  # changes done again because another writer touched the same buckets
        self.folder = Folder(spark, self.path)

    # ---- versions

    def _load(self, number: int) -> Version | None:
        """A version's manifest; None if it is gone, or still being written."""
        try:
            m = self.folder.read(f"_manifests/{number:012d}.json")
        except (Py4JJavaError, ValueError):
            return None
        return Version(number, m["folders"], m["touched"], m["time"])

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.folder.names("_manifests") if n.endswith(".json"))

    def latest(self) -> Version:
        for number in reversed(self.versions()):
            if found := self._load(number):
                return found
        return EMPTY

    def current(self) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return self.latest().folders

    def state(self) -> str:
        """A fingerprint of the table as it is now: its folders, which are never written twice, so no row is read."""
        return fingerprint(self.current())

    # ---- reading

    def read(self, only: set[str] | None = None, at: Version | None = None) -> DataFrame:
        folders = [f for b, f in (at or self.latest()).folders.items() if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    @contextlib.contextmanager
    def lease(self, seconds: float = 86_400.0) -> Iterator[DataFrame]:
        """The table as it is now, which no vacuum takes away before the block ends (or, if its process dies, the time is over)."""
        name = f"_leases/{uuid.uuid4().hex}.json"
        while True:
            version = self.latest()
            self.folder.put(name, {"version": version.number, "until": time.time() + seconds})
            if version is EMPTY or self._load(version.number):  # still there, now that the lease is
                break
        try:
            yield self.read(at=version)
        finally:
            self.folder.delete(name)

    # ---- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> set[str]:
        return {str(r[0]) for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most `buckets`

    def change(self, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> tuple[Version, Version] | None:
        """Puts merge(rows) in place of the rows of the buckets that keys fall into; merge must give no keys of others. It is
        called again on the new rows if another writer changes them meanwhile. The versions before and after, if keys has any."""
        touched = self.buckets_of(keys)
        return self._write(lambda base: merge(self.read(touched, base)), touched) if touched else None

    def write(self, df: DataFrame) -> tuple[Version, Version]:
        """Replaces the whole table."""
        return self._write(lambda base: df, None)

    def _write(self, make: Callable[[Version], DataFrame], touched: set[str] | None) -> tuple[Version, Version]:
        base, new = self.latest(), None
        for _ in range(self.attempts):
            if new is None:
                new = self._data(make(base))
            kept = {} if touched is None else {b: f for b, f in base.folders.items() if b not in touched}
            made = Version(base.number + 1, kept | new, None if touched is None else sorted(touched), time.time())
            if self.folder.create(f"_manifests/{made.number:012d}.json", {"folders": made.folders, "touched": made.touched, "time": made.time}):
                self.vacuum()
                return base, made
            since, base = base.number, self.latest()
            others = [self._load(k) for k in range(since + 1, base.number + 1)]
            if touched is not None and any(v is None or v.touched is None or touched & set(v.touched) for v in others):
                self.retries += 1  # what was written is of no version, and goes with a later vacuum
                new = None
        raise Conflict(f"{self.path}: {self.attempts} attempts to publish failed")

    def _data(self, df: DataFrame) -> dict[str, str]:
        version = f"v-{uuid.uuid4().hex}"
        rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("_bucket", self._bucket())
        # rebalanced, not repartitioned: a large bucket is split among tasks
        rows.hint("rebalance", "_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{version}")
        return {n.removeprefix("_bucket="): f"{version}/{n}" for n, _ in self.folder.names(version) if n.startswith("_bucket=")}

    def vacuum(self, retention: float | None = None, now: float | None = None) -> int:
        """Deletes manifests superseded longer than the retention ago and in no lease, and folders that no manifest left names and
        that are as old; the number of folders deleted."""
        retention, now = self.retention if retention is None else retention, time.time() if now is None else now
        leased = set()
        for name, _ in self.folder.names("_leases"):
            with contextlib.suppress(Py4JJavaError, ValueError):
                lease = self.folder.read(f"_leases/{name}")
                if lease["until"] >= now:
                    leased.add(lease["version"])
                else:
                    self.folder.delete(f"_leases/{name}")
        found = [v for k in self.versions() if (v := self._load(k))]
        kept = [v for v, after in zip(found, [*found[1:], None], strict=True) if after is None or after.time > now - retention or v.number in leased]
        for v in found:
            if v not in kept:
                self.folder.delete(f"_manifests/{v.number:012d}.json")
        named, deleted = {f for v in kept for f in v.folders.values()}, 0
        for name, written in self.folder.names(""):
            if not name.startswith("v-"):
                continue
            parts = [n for n, _ in self.folder.names(name) if n.startswith("_bucket=")]
            dead = [n for n in parts if f"{name}/{n}" not in named]
            if dead and written <= now - retention:  # a young one may be another writer's
                for n in parts if len(dead) < len(parts) else []:
                    if n in dead:
                        self.folder.delete(f"{name}/{n}")
                if len(dead) == len(parts):
                    self.folder.delete(name)
                deleted += len(dead)
        return deleted


def fingerprint(folders: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(sorted(folders.items())).encode()).hexdigest()
