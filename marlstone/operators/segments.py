"""Indexes in segments: a run adds one segment of the rows that came and one set of marks for those that went.

A mark of run k kills a row's id in segments of a lower number than k alone, so an id may go and come back. Numbered manifests name
the segments; one writer publishes the next one, and the tables of the manifest before it stay for its readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.snapshot import Folder

EMPTY = {"next": 1, "fingerprint": None, "segments": [], "gone": []}


class Segments:
    """Tables <kind>/seg=<name> under `path`; ids are of id_type, string or long."""

    kinds: tuple[str, ...] = ("marks",)

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.folder = Folder(spark, self.path)

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self.folder.names("manifests"))

    def manifest(self) -> dict:
        versions = self._versions()
        return self.folder.read(f"manifests/{versions[-1]:012d}.json") if versions else EMPTY

    def fingerprint(self) -> str | None:
        """Of the store's state that the index was last brought to."""
        return self.manifest()["fingerprint"]

    @property
    def n(self) -> int:
        """Live rows."""
        m = self.manifest()
        return sum(s["n"] for s in m["segments"]) - sum(g["n"] for g in m["gone"])

    def _table(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/seg={n}" for n in names])

    def _marks(self, m: dict) -> DataFrame:
        """chunk_id, killed_from: chunks that are gone from segments of a lower number."""
        found = self._table("marks", [g["name"] for g in m["gone"] if not g.get("unmarked")], f"chunk_id {self.id_type}, seg string")
        return found.select("chunk_id", _number({g["name"]: g["seq"] for g in m["gone"]}).alias("killed_from"))

    def live(self, rows: DataFrame, m: dict) -> DataFrame:
        """rows (chunk_id, seg, ...) without those of chunks that are gone."""
        if all(g.get("unmarked") for g in m["gone"]):
            return rows
        own = rows.withColumn("_seq", _number({s["name"]: s["seq"] for s in m["segments"]}))
        marks = self._marks(m).withColumnRenamed("chunk_id", "_gone")
        return own.join(marks, (F.col("chunk_id") == F.col("_gone")) & (F.col("killed_from") > F.col("_seq")), "left_anti").drop("_seq")

    def _commit(self, old: dict, new: dict) -> bool:
        """Whether the manifest is published. If another writer was faster, it is not, and what it would have named goes."""
        versions = self._versions()
        names = {x["name"] for x in old["segments"] + old["gone"]}
        if not self.folder.create(f"manifests/{(versions[-1] if versions else 0) + 1:012d}.json", new):
            for x in new["segments"] + new["gone"]:
                if x["name"] not in names:
                    self._drop(x["name"])
            return False
        # the tables of the manifest before this one stay for those who read it
        for number in versions[:-1]:
            stale = self.folder.read(f"manifests/{number:012d}.json")
            kept = {x["name"] for v in (old, new) for x in v["segments"] + v["gone"]}
            for x in stale["segments"] + stale["gone"]:
                if x["name"] not in kept:
                    self._drop(x["name"])
            self.folder.delete(f"manifests/{number:012d}.json")
        return True

    def _drop(self, name: str) -> None:
        for kind in self.kinds:
            self.folder.delete(f"{kind}/seg={name}")

    def _mark(self, ids: DataFrame, name: str) -> None:
        ids.select("chunk_id").write.parquet(f"{self.path}/marks/seg={name}")


def _number(of: dict[str, int]) -> Column:
    """The number of a row's segment."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("seg"))
