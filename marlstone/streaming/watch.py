"""A folder as a stream of changes: what is new, changed and deleted since the listing before.

The source lists the tree once a trigger, its subtrees in tasks and without the folders that are excluded. Every path has a
state, the time it was last modified at, and a timer a millisecond after the batch that saw it. A later listing that names the
path moves the timer on, as rows come before timers in a batch; of a path that it does not name the timer is due, and the path
is reported as deleted in that same batch. A root that cannot be listed fails the query, lest all its files be deleted.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from marlstone.functions.text import nfc
from marlstone.operators import tables
from marlstone.operators.snapshot import Snapshot
from marlstone.plans.indexing import Indexer
from marlstone.sources import scan, tree

LISTED = "place string, mtime double, length long"
CHANGED = "file_path string, change string, place string, mtime double, length long"


class Subtree(InputPartition):
    def __init__(self, place: str, deep: bool):
        self.place, self.deep = place, deep


class ListingReader(DataSourceStreamReader):
    """One listing a trigger; its offset is its time in milliseconds. A partition is a subtree, or a folder's own files."""

    def __init__(self, root: str, patterns: list[str], partitions: int):
        self.root, self.excluded, self.wanted, self.last = root, re.compile("|".join(f"(?:{p})" for p in patterns) or r"(?!)"), partitions, 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.last = max(int(time.time() * 1000), self.last + 10)
        return {"at": self.last}

    def _below(self, place: str) -> tuple[list[str], bool]:
        """The folders in a folder that are entered, and whether it has files."""
        found = list(tree.entries(place))
        if place == self.root and any(folder is None for _, folder, *_ in found):
            raise OSError(f"{place} cannot be listed: {found[0][4]}")
        return [p for p, folder, *_ in found if folder and not self.excluded.search(p.rsplit("/", 1)[-1])], any(folder is False for _, folder, *_ in found)

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        done, open_ = [], [self.root]
        while open_ and len(done) + len(open_) < self.wanted:  # from the top, until there are enough
            below = []
            for place in open_:
                folders, files = self._below(place)
                below += folders
                if files:
                    done.append(Subtree(place, False))
            open_ = below
        return [*done, *(Subtree(p, True) for p in open_)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        open_ = [partition.place]
        while open_:
            for place, folder, mtime, length, error in tree.entries(open_.pop()):
                if folder and partition.deep:
                    if not self.excluded.search(place.rsplit("/", 1)[-1]):
                        open_.append(place)
                elif folder is False and error is None:
                    yield place, mtime, length


class Listings(DataSource):
    """spark.readStream.format("marlstone_listings"): options path, partitions, and exclude, a line a pattern."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_listings"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> ListingReader:
        patterns = [p for p in self.options.get("exclude", "").split("\n") if p]
        return ListingReader(self.options["path"], patterns, int(self.options.get("partitions", "16")))


class Seen(StatefulProcessor):
    """Of each path the modification time and length it was last listed with."""

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "place string, mtime double, length long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("place")  # names that composing makes equal are one file, that of the least place
        place, mtime, length = found.iloc[0][["place", "mtime", "length"]]
        change = "new"
        if self.seen.exists():
            _, before, _, timer = self.seen.get()
            self.handle.deleteTimer(timer)
            change = None if before == mtime else "changed"
        timer = timerValues.getCurrentProcessingTimeInMs() + 1
        self.handle.registerTimer(timer)
        self.seen.update((place, float(mtime), int(length), timer))
        if change:
            yield pd.DataFrame({"file_path": [key[0]], "change": [change], "place": [place], "mtime": [float(mtime)], "length": [int(length)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, mtime, length, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"file_path": [key[0]], "change": ["deleted"], "place": [place], "mtime": [mtime], "length": [length]})

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, more: tuple[str, ...] = (), max_mb: int = 500, partitions: int = 16) -> DataFrame:
    """A stream of file_path, change (new, changed or deleted), place, mtime, length. A file that is no longer of a size or name that
    counts is deleted, too."""
    spark.dataSource.register(Listings)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    patterns = "\n".join(scan.valid_patterns((*scan.EXCLUDED, *more)))
    listed = spark.readStream.format("marlstone_listings").options(path=root, exclude=patterns, partitions=str(partitions)).load()
    plain = listed.withColumn("file_path", nfc(F.regexp_replace("place", "^file:/*", "/")))
    return scan.select_files(plain, root, more, max_mb).groupBy("file_path").transformWithStateInPandas(Seen(), CHANGED, "Append", "ProcessingTime")


def keep(indexer: Indexer, checkpoint: str, **trigger):
    """A query that keeps an index equal to its folder: new, changed and deleted files alike (by default what there is now)."""

    def apply(batch: DataFrame, _: int) -> None:
        with indexer._stage() as folder:
            found = indexer._staged(batch, f"{folder}/batch")
            listing = found.where("change <> 'deleted'").select("file_path", "place", "mtime", "length")
            indexer._apply(found.select("file_path", "change"), listing, folder, "")

    stream = changes(indexer.spark, indexer.root, indexer.excluded, indexer.max_mb)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def record(stream: DataFrame, target: Snapshot, checkpoint: str):
    """Keeps a table of file_path, mtime equal to the folder, of the stream of its changes."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        live = rows.where("change <> 'deleted'").select(*[f.name for f in target.schema.fields])
        target.change(rows, lambda old: tables.delete_files(old, rows).unionByName(live))
        rows.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
