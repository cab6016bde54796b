"""Approximate nearest neighbours by cosine distance: inverted lists, product-quantised residuals, exact re-scoring.

Unit vectors are dealt into the lists of their nearest centroid (k-means, trained by Spark ML on a bounded sample of rows). A row's
code says, part by part, which of 256 learned vectors is nearest to what the centroid leaves. A query probes its nearest lists, which
are partitions of the table, so the scan reads no other; there it reads codes alone, adds up their distances from a
table a query, and keeps the best few; only for these are vectors read, and their true distances rank them. Filters hold within
the scan. How many lists are probed is measured at the build: the fewest that keep the wanted share of true neighbours of
sampled rows; and so is how many candidates the codes must leave, as these lose more the more rows there are. vector.top stays the
exact way.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import distance_score
from marlstone.operators import vector
from marlstone.operators.segments import Segments


def near(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)


def lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the rows of a bounded sample, from rows spread evenly over it; centres that lose all rows stay."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = near(x, centers)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


class VectorIndex(Segments):
    """The index under `path`; `keep` are the columns that filters compare."""

    kinds = ("vectors", "marks")

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", keep: tuple[str, ...] = (), parts: int = 8, most_lists: int = 4096, sample: int = 1 << 16, refine: int = 8, target: float = 0.95):
        super().__init__(spark, path, id_type)
        self.keep, self.parts, self.most_lists, self.sample, self.refine, self.target = keep, parts, most_lists, sample, refine, target

    # ---- writing

    def build(self, store: DataFrame, fingerprint: str) -> None:
        """The index anew, of store (chunk_id, embedding, the kept columns). Rows without a vector are near nothing and are left
        out. Centroids and codes are fitted on `sample` rows by id hash at most; every row is indexed."""
        rows = store.where("embedding is not null").select("chunk_id", "embedding", *self.keep)
        m = self.manifest()
        n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        made = {"next": m["next"] + 1, "fingerprint": fingerprint, "segments": [], "gone": [], "trained": n, "dim": dim, "model": None, "probes": 1, "unmeasured": 0}
        if n:
            made["model"] = f"models/{uuid.uuid4().hex}.json"
            part = rows if n <= self.sample else rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(-(-n // self.sample))) == 0).limit(self.sample)
            x = vector._unit(_matrix(part.select("chunk_id", "embedding").orderBy("chunk_id").toArrow()["embedding"]))  # `sample` rows
            lists = max(1, min(self.most_lists, int(math.sqrt(n)), len(x) // 8))
            model = self._fit(part, x, lists)
            self.folder.put(made["model"], {k: v.tolist() for k, v in model.items()})
            made["segments"] = self._segment(rows, model, m["next"])
            made |= self._measured(made, model)
        self._commit(m, made)

    def append(self, added: DataFrame, removed: DataFrame, fingerprint: str) -> None:
        """A segment of the rows that came and marks for those that went (chunk_id). The probes are measured again once a tenth of
        the rows is new; once there are four times the rows that the centroids were fitted for, build() anew."""
        m = self.manifest()
        rows = added.where("embedding is not null").select("chunk_id", "embedding", *self.keep)
        model = self._model(m) if m.get("model") else None
        new = self._segment(rows, model, m["next"]) if model else []
        name = f"{m['next']:08d}-{uuid.uuid4().hex[:8]}"
        known = self.live(self._vectors(m).select("chunk_id", "seg"), m).select("chunk_id").join(removed.select("chunk_id"), "chunk_id", "left_semi")
        self._mark(known, name)
        n = self.spark.read.parquet(f"{self.path}/marks/seg={name}").count()
        made = m | {"next": m["next"] + 1, "fingerprint": fingerprint, "segments": m["segments"] + new, "gone": m["gone"] + ([{"name": name, "seq": m["next"], "n": n}] if n else [])}
        made["unmeasured"] = m.get("unmeasured", 0) + sum(s["n"] for s in new)
        if model and 10 * made["unmeasured"] > sum(s["n"] for s in made["segments"]):
            made |= self._measured(made, model) | {"unmeasured": 0}
        self._commit(m, made)

    def _fit(self, part: DataFrame, x: np.ndarray, lists: int) -> dict[str, np.ndarray]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if lists > 1:
            norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
            unit = part.select(array_to_vector(F.transform("embedding", lambda v: F.when(norm > 0, v / norm).otherwise(0.0))).alias("features"))
            centers = np.array(KMeans(k=lists, maxIter=12, seed=7, initSteps=2).fit(unit).clusterCenters())
        else:
            centers = x.mean(0, keepdims=True)
        rest = x - centers[near(x, centers)]
        bounds = np.linspace(0, x.shape[1], min(self.parts, x.shape[1]) + 1).astype(int)
        width = int(np.diff(bounds).max())
        books = np.zeros((len(bounds) - 1, min(256, len(x)), width))
        # each part by itself, in a task of its own
        sub = [(p, np.ascontiguousarray(rest[:, a:b]).astype(np.float32).tobytes(), int(b - a)) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        k = books.shape[1]

        def learn(t: pd.DataFrame) -> pd.DataFrame:
            y = np.frombuffer(t["rows"].iloc[0], np.float32).reshape(-1, int(t["width"].iloc[0])).astype(np.float64)
            return pd.DataFrame({"part": [t["part"].iloc[0]], "book": [lloyd(y, k).tobytes()]})

        for r in self.spark.createDataFrame(sub, "part int, rows binary, width int").groupBy("part").applyInPandas(learn, "part int, book binary").collect():
            w = int(bounds[r["part"] + 1] - bounds[r["part"]])
            books[r["part"], :, :w] = np.frombuffer(r["book"], np.float64).reshape(k, w)
        return {"centers": centers, "books": books, "bounds": bounds}

    def _model(self, m: dict) -> dict[str, np.ndarray]:
        return {k: np.array(v) for k, v in self.folder.read(m["model"]).items()}

    def _segment(self, rows: DataFrame, model: dict, seq: int) -> list[dict]:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        sent, at = self.spark.sparkContext.broadcast(model), rows.columns.index("embedding")

        def encode(batches):
            for batch in batches:
                if batch.num_rows:
                    own, codes = encoded(vector._unit(_matrix(batch.column(at))), sent.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "list", "code"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        made = rows.mapInArrow(encode, f"{kinds}, list int, code binary")
        made.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id").write.option("parquet.block.size", 16 << 20).partitionBy("list").parquet(f"{self.path}/vectors/seg={name}")
        if not self.folder.names(f"vectors/seg={name}"):
            return []
        n = self.spark.read.parquet(f"{self.path}/vectors/seg={name}").count()
        return [{"name": name, "seq": seq, "n": n}] if n else []

    def _measured(self, m: dict, model: dict, queries: int = 256, n: int = 10, most: int = 256) -> dict[str, int]:
        """The fewest probes with which `target` of the true neighbours of sampled rows (but themselves) lie in probed lists, in
        each segment, as rows that came later may lie otherwise than those that the centroids were fitted for. And the fewest
        candidates a neighbour, `refine` to `most`, with which the codes lose half as large a share of these at most."""
        rows = self.live(self._vectors(m).select("chunk_id", "embedding", "list", "seg"), m)
        total = sum(s["n"] for s in m["segments"]) - sum(g["n"] for g in m["gone"])
        some = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(max(1, total // queries))) == 0).limit(2 * queries).select(F.col("chunk_id").alias("query_id"), "embedding", "seg").toArrow()
        if not some.num_rows:
            return {"probes": len(model["centers"]), "refine": self.refine}
        frame = self.spark.createDataFrame(some.select(["query_id", "embedding"]))
        true = vector.batch_top(rows.select("chunk_id", "embedding"), frame, n + 1).where("rank > 1").join(rows.select("chunk_id", "list"), "chunk_id").select("query_id", "chunk_id", "list")
        true = self.spark.createDataFrame(true.toArrow())  # n rows a query
        x = vector._unit(_matrix(some["embedding"]))
        order = np.argsort(-(x @ model["centers"].T - (model["centers"] ** 2).sum(1) / 2), axis=1, kind="stable")
        place, at = np.argsort(order, axis=1), {q: (k, seg) for k, (q, seg) in enumerate(zip(some["query_id"].to_pylist(), some["seg"].to_pylist(), strict=True))}
        ranks: dict[str, list[int]] = {}
        for r in true.collect():
            k, seg = at[r["query_id"]]
            ranks.setdefault(seg, []).append(int(place[k, r["list"]]))
        probes = 1 + max((_within(v, self.target) for v in ranks.values()), default=0)
        kind = frame.schema["query_id"].dataType.simpleString()
        guessed = self._guessed(m, model, some.select(["query_id", "embedding"]), kind, most * n, None, probes)
        lost: dict[str, list[int]] = {}
        for r in true.join(guessed, ["query_id", "chunk_id"], "left").collect():
            k, seg = at[r["query_id"]]
            if place[k, r["list"]] < probes:
                lost.setdefault(seg, []).append((r["k"] or most * n + 1) - 1)  # the row itself is before
        deepest = max((_within(v, (1 + self.target) / 2) for v in lost.values()), default=0)
        return {"probes": probes, "refine": max(self.refine, math.ceil(deepest / n))}

    # ---- search

    def _vectors(self, m: dict) -> DataFrame:
        kept = "".join(f", `{c}` string" for c in self.keep)
        return self._table("vectors", [s["name"] for s in m["segments"]], f"chunk_id {self.id_type}, embedding array<float>{kept}, code binary, seg string, list int")

    def top(self, query: Sequence[float], n: int = 50, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """chunk_id, distance, score of the n nearest rows that the probed lists hold; ties follow the id."""
        asked = self.spark.createDataFrame([(0, [float(v) for v in query])], "query_id int, embedding array<double>")
        return self.batch(asked, n, where, probes).orderBy("distance", "chunk_id").select("chunk_id", "distance", "score")

    def batch(self, queries: DataFrame, n: int = 50, where: Column | None = None, probes: int | None = None, block: int = 256) -> DataFrame:
        """query_id, chunk_id, distance, score, rank of queries (query_id, embedding), `block` of them a pass."""
        m = self.manifest()
        kind = queries.schema["query_id"].dataType.simpleString()
        out = self.spark.createDataFrame([], f"query_id {kind}, chunk_id {self.id_type}, distance double, score double, rank int")
        if not m["segments"]:
            return out
        model, probes = self._model(m), probes or m["probes"]
        queries = queries.where("embedding is not null").select("query_id", "embedding")
        blocks = -(-queries.count() // block)
        for k in range(blocks):
            some = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow()
            if some.num_rows:
                found = self._block(m, model, some, kind, n, where, probes)
                out = found if k == 0 else out.unionByName(found)
        return out

    def _block(self, m: dict, model: dict, asked: pa.Table, kind: str, n: int, where: Column | None, probes: int) -> DataFrame:
        wanted = max(n, 10) * max(self.refine, m.get("refine", 0))
        chosen = self._guessed(m, model, asked, kind, wanted, where, probes).select("query_id", "chunk_id")
        # the true distances of a few rows a query
        vectors = self.live(self._probed(m, model, asked, where, probes)[0].select("chunk_id", "embedding", "seg"), m).select("chunk_id", "embedding")
        own = self.spark.createDataFrame(list(zip(asked["query_id"].to_pylist(), asked["embedding"].to_pylist(), strict=True)), f"query_id {kind}, asked array<double>")
        both = vectors.join(F.broadcast(chosen), "chunk_id").join(F.broadcast(own), "query_id")
        exact = both.select("query_id", "chunk_id", F.round(vector.cosine_distance(F.col("embedding"), F.col("asked")), 9).alias("distance"))
        ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("rank") <= n)
        return ranked.select("query_id", "chunk_id", "distance", distance_score(F.col("distance")).alias("score"), "rank")

    def _probed(self, m: dict, model: dict, asked: pa.Table, where: Column | None, probes: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
        """The rows of the lists that some query probes, and the queries by list."""
        x, centers = vector._unit(_matrix(asked["embedding"])), model["centers"]
        probed = np.argsort(-(x @ centers.T - (centers**2).sum(1) / 2), axis=1, kind="stable")[:, :probes]
        by_list: dict[int, np.ndarray] = {int(c): np.flatnonzero((probed == c).any(1)) for c in np.unique(probed)}
        rows = self._vectors(m).where(F.col("list").isin(sorted(by_list)))
        return rows if where is None else rows.where(where), by_list

    def _guessed(self, m: dict, model: dict, asked: pa.Table, kind: str, wanted: int, where: Column | None, probes: int) -> DataFrame:
        """query_id, chunk_id, k of the `wanted` rows that codes say are nearest, nearest first."""
        x, names = vector._unit(_matrix(asked["embedding"])), asked["query_id"].combine_chunks()
        centers, books, bounds = model["centers"], model["books"], model["bounds"]
        rows, by_list = self._probed(m, model, asked, where, probes)
        # products of queries and code vectors: a row's distance is a sum of these, the centroid's and the code's own size
        products = np.stack([x[:, a:b] @ books[p, :, : b - a].T for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])
        to_center = x @ centers.T

        def score(batches):
            best: dict[int, tuple] = {}
            for batch in batches:
                lists, codes = batch.column(2).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                ids = batch.column(0)
                for c in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == c)
                    for q in by_list[c].tolist():
                        near_ = to_center[q, c] + sum(products[p, q, codes[at, p]] for p in range(codes.shape[1]))
                        held = best.get(q)
                        value = near_ if held is None else np.concatenate((held[0], near_))
                        own = ids.take(pa.array(at)) if held is None else pa.concat_arrays([held[1], ids.take(pa.array(at))])
                        if len(value) > wanted:
                            keep = np.argpartition(-value, wanted - 1)[:wanted]
                            value, own = value[keep], own.take(pa.array(keep))
                        best[q] = (value, own)
            for q, (value, own) in best.items():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(own), q))), own, pa.array(value)], names=["query_id", "chunk_id", "near"])

        live = self.live(rows.select("chunk_id", "code", "list", "seg"), m).select("chunk_id", "code", "list")
        guessed = live.mapInArrow(score, f"query_id {kind}, chunk_id {self.id_type}, near double")
        return guessed.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))).where(F.col("k") <= wanted).select("query_id", "chunk_id", "k")


def _within(ranks: list[int], share: float) -> int:
    """The rank that `share` of the ranks do not go beyond."""
    return sorted(ranks)[math.ceil(share * len(ranks)) - 1]


def encoded(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The list of each unit vector, and its code: a byte a part."""
    own = near(x, model["centers"])
    rest, bounds = x - model["centers"][own], model["bounds"]
    return own, np.stack([near(rest[:, a:b], model["books"][p, :, : b - a]) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))], axis=1).astype(np.uint8)


def _matrix(lists) -> np.ndarray:
    return vector._matrix(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists)
