"""A keyword index that is kept: segments of postings in blocks, marks for what is deleted, and search that skips blocks.

A run appends one segment of the chunks that came and one set of marks for those that went, with the words these had, so that
statistics are those of a full build. Segments of like size are merged, `fan` at a time.

Within a segment chunks are numbered in id order and dealt into blocks of 128; a posting row holds the places of a term's chunks in
one block, with the largest count and the least length among them. No row a word and chunk is staged or shuffled: a task packs what
a term has in the next 2^20 words or so of its chunks into one row, and blocks come of these rows when they are dealt. Ids and
lengths lie in the docs table alone, by block and place. Rows lie in buckets by term and are
sorted, so a query reads its own terms' rows. It first reads the blocks' bounds alone: the sum of a block's bounds over the terms is as much as any chunk in it can
score. The n best bounds' blocks are scored, and the n-th score found says which other blocks could still matter; no
other is read. The result is exact. Bounds hold a count and a length, not a score, so they stay right as the mean length changes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.packed import pack, unpack
from marlstone.functions.text import tokens
from marlstone.operators.bm25 import B, DELTA, K1
from marlstone.operators.segments import EMPTY, Segments

BLOCK_BITS = 7
BLOCK = 1 << BLOCK_BITS
BUCKETS = 64
#: Chunks that a task packs at once, at most.
RUN_CHUNKS = 1 << 15
#: Of the tables; an index of another form is as none, and built anew.
FORM = 2


class KeywordIndex(Segments):
    """The index under `path`."""

    kinds = ("postings", "docs", "marks", "terms")

    def __init__(self, spark: SparkSession, path: str, split: Callable[[Column], Column] = tokens, id_type: str = "string", fan: int = 8, spread_from: int = 1 << 16, literals: int = 4096, run_words: int = 1 << 20):
        super().__init__(spark, path, id_type)
        self.split, self.fan, self.spread_from, self.literals, self.run_words = split, fan, spread_from, literals, run_words
        self._postings = "bucket int, term string, block long, n int, max_tf int, min_dl int, ats array<tinyint>, tfs array<int>, seg string"

    # ---- what there is

    def manifest(self) -> dict:
        m = super().manifest()
        return m if m.get("form") == FORM else EMPTY | {"next": m["next"], "form": FORM}

    @property
    def avgdl(self) -> float:
        m = self.manifest()
        return _mean(m)

    def postings(self, m: dict | None = None) -> DataFrame:
        """term, block, n, max_tf, min_dl, ats (places in the block), tfs by seg and bucket."""
        return self._table("postings", [s["name"] for s in (m or self.manifest())["segments"]], self._postings)

    def _docs(self, m: dict) -> DataFrame:
        return self._table("docs", [s["name"] for s in m["segments"]], f"chunk_id {self.id_type}, dl int, block long, at tinyint, seg string")

    # ---- writing

    def build(self, chunks: DataFrame, fingerprint: str) -> None:
        """The index anew, of chunks (chunk_id, text), in one segment."""
        m = self.manifest()
        self._commit(m, {"next": m["next"] + 1, "form": FORM, "fingerprint": fingerprint, "segments": self._segment(chunks, m["next"]), "gone": []})

    def append(self, added: DataFrame, removed: DataFrame, fingerprint: str) -> None:
        """One segment of the chunks that came and one set of marks for those that went (chunk_id, text, as they were)."""
        m = self.manifest()
        made = {"next": m["next"] + 1, "form": FORM, "fingerprint": fingerprint, "segments": m["segments"] + self._segment(added, m["next"]), "gone": m["gone"] + self._removal(removed, m["next"])}
        self._commit(m, self._merged(made))

    def _segment(self, chunks: DataFrame, seq: int) -> list[dict]:
        """Tables of new chunks; each text is split once, and its words are counted where it is. Nothing is written for none."""
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        staged = f"{self.path}/staged/{name}"
        ordered = chunks.select("chunk_id", "text").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        words = ordered.select("chunk_id", F.coalesce(self.split(F.col("text")), F.array().cast("array<string>")).alias("words"))
        run_words = self.run_words
        made = words.mapInArrow(lambda batches: _posted(batches, run_words), f"chunk_id {self.id_type}, dl int, at tinyint, term string, block long, places binary")
        made.write.option("compression", "zstd").parquet(staged)
        made = self.spark.read.schema(made.schema).parquet(staged)
        docs = made.where("term is null").select("chunk_id", "dl", "block", "at")
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        rows = self._dealt(made.where("term is not null").select("term", "block", "places"), n)
        rows = rows.mapInArrow(_unrolled, "bucket int, term string, block long, n int, max_tf int, min_dl int, ats array<tinyint>, tfs array<int>")
        out = [self._write(name, seq, rows, docs, n, total)] if n else []
        self.folder.delete(f"staged/{name}")
        return out

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """rows (term, block, ...) of a segment of n chunks, dealt by bucket, term and block."""
        bucket = _bucket(F.col("term")) if n >= self.spread_from else F.lit(0)
        return rows.select(bucket.alias("bucket"), "*").repartitionByRange("bucket", "term", "block")

    def _write(self, name: str, seq: int, rows: DataFrame, docs: DataFrame, n: int, total: int) -> dict:
        """A segment of posting rows, dealt, and docs (chunk_id, dl, block, at)."""
        rows.sortWithinPartitions("bucket", "term", "block").write.option("parquet.block.size", 4 << 20).option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/seg={name}")
        docs.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{self.path}/docs/seg={name}")
        return {"name": name, "seq": seq, "n": n, "words": int(total), "spread": n >= self.spread_from}

    def _removal(self, removed: DataFrame, seq: int) -> list[dict]:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        removed.select("chunk_id", F.coalesce(self.split(F.col("text")), F.array().cast("array<string>")).alias("words")).write.parquet(f"{self.path}/staged/{name}")
        words = self.spark.read.parquet(f"{self.path}/staged/{name}")
        n, total = words.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        if n:
            self._mark(words, name)
            self._write_terms(name, words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
        self.folder.delete(f"staged/{name}")
        return [{"name": name, "seq": seq, "n": n, "words": int(total)}] if n else []

    def _write_terms(self, name: str, terms: DataFrame) -> None:
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/terms/seg={name}")

    def _merged(self, m: dict) -> dict:
        """The manifest after merges of `fan` segments of one size class, the smallest class first; of all, once a quarter is dead."""
        while True:
            dead = sum(g["n"] for g in m["gone"])
            classes: dict[int, list[dict]] = {}
            for s in m["segments"]:
                classes.setdefault(int(math.log(max(s["n"], 1), self.fan)), []).append(s)
            full = sorted(k for k, v in classes.items() if len(v) >= self.fan)
            if dead and 4 * dead > sum(s["n"] for s in m["segments"]):
                m = self._merge(m, m["segments"])
            elif full:
                m = self._merge(m, classes[full[0]])
            else:
                return m

    def _merge(self, m: dict, some: list[dict]) -> dict:
        """One segment in place of some; what is dead in them goes, and with it the counts that stood for it."""
        seq, names = m["next"], [s["name"] for s in some]
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        docs = self.live(self._docs(m).where(F.col("seg").isin(names)), m)
        staged = f"{self.path}/staged/{name}"
        number = F.monotonically_increasing_id()  # ascends in a partition; those of different ones differ in their high bits, so no block spans two
        numbered = docs.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").select("chunk_id", "dl", "seg", F.col("block").alias("was"), F.col("at").alias("was_at"), number.alias("number"))
        numbered = numbered.select("chunk_id", "dl", "seg", "was", "was_at", F.shiftright("number", BLOCK_BITS).alias("block"), F.col("number").bitwiseAND(BLOCK - 1).cast("tinyint").alias("at"))
        numbered.write.parquet(staged)
        numbered = self.spark.read.schema(numbered.schema).parquet(staged)
        n, total = numbered.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        rows = self.postings(m).where(F.col("seg").isin(names))
        whole = len(some) == len(m["segments"])
        segments = [s for s in m["segments"] if s["name"] not in names]
        gone = [] if whole else list(m["gone"])
        old = _unpacked(rows).withColumnsRenamed({"block": "was", "at": "was_at"})
        alive = old.join(numbered, ["seg", "was", "was_at"]).select("term", "block", "at", "tf", "dl")
        if n:
            # dealt once: a posting row's chunks are of one range
            posted = self._dealt(alive, n).groupBy("bucket", "term", "block").agg(F.array_sort(F.collect_list(F.struct("at", "tf", "dl"))).alias("p"))  # of at most 128 chunks
            posted = posted.select("bucket", "term", "block", F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"), F.col("p.at").alias("ats"), F.col("p.tf").alias("tfs"))
            segments.append(self._write(name, seq, posted, numbered.select("chunk_id", "dl", "block", "at"), n, total))
        died, lost = sum(s["n"] for s in some) - n, sum(s["words"] for s in some) - int(total)
        if died and not whole:
            # marks keep standing for chunks in other segments; what they stood for here is counted no more
            fell = rows.groupBy("term").agg(F.sum("n").alias("df")).unionByName(alive.groupBy("term").agg((-F.count("*")).alias("df")))
            self._write_terms(name, fell.groupBy("term").agg((-F.sum("df")).alias("df")).where("df <> 0"))
            gone.append({"name": name, "seq": seq, "n": -died, "words": -lost, "unmarked": True})
        self.folder.delete(f"staged/{name}")
        return m | {"next": seq + 1, "segments": segments, "gone": gone}

    # ---- search

    def search(self, queries: DataFrame, n: int = 50, delta_mode: str = "library", digits: int = 9) -> DataFrame:
        """query_id, chunk_id, score, rank as bm25.search gives them. The queries are a set that a user asks: their words come to
        the driver."""
        kind = queries.schema["query_id"].dataType.simpleString()
        out = f"query_id {kind}, chunk_id {self.id_type}, score double, rank int"
        m = self.manifest()
        asked = queries.select("query_id", F.explode_outer(self.split(F.col("text"))).alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("times")).select("*", _bucket(F.col("term")).alias("bucket")).collect()
        weights = self._weights(m, asked)
        if not weights:
            return self.spark.createDataFrame([], out)
        rows = self._asked(m, asked, {t for _, t, _ in weights})
        weighed = F.broadcast(self.spark.createDataFrame(weights, f"query_id {kind}, term string, weight double"))
        paper, mean = delta_mode == "paper", _mean(m)
        floor = F.col("weight") * DELTA if paper else F.lit(0.0)
        bound = F.sum(F.col("weight") * _gain(F.col("max_tf"), F.col("min_dl"), mean) + floor)
        bounds = rows.join(weighed, "term").groupBy("query_id", "seg", "block").agg(bound.alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "block")
        first = bounds.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("query_id", "seg", "block").collect()
        hits = self._scored(m, rows, weighed, first, kind, paper, mean)
        found = hits.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("gain", digits)), "chunk_id"))).where(F.col("k") <= n).collect()
        least: dict = {}
        for r in found:
            if r["k"] == n:
                least[r["query_id"]] = r["gain"]
        # a block whose bound is below the n-th gain holds none of the n best; what rounding makes equal still counts
        limits = F.broadcast(self.spark.createDataFrame([(q, least.get(q, 0.0) - 2 * 10.0**-digits) for q in {w[0] for w in weights}], f"query_id {kind}, least double"))
        done = F.broadcast(self.spark.createDataFrame([tuple(r) for r in first], f"query_id {kind}, seg string, block long"))
        rest = bounds.join(limits, "query_id").where("bound >= least").join(done, ["query_id", "seg", "block"], "left_anti").select("query_id", "seg", "block")
        head = rest.limit(self.literals + 1).collect()
        more = self._scored(m, rows, weighed, head, kind, paper, mean) if len(head) <= self.literals else self._scored(m, rows, weighed, rest, kind, paper, mean)
        # a chunk's terms are all of one block, so what is found already is whole
        gains = self.spark.createDataFrame([(r["query_id"], r["chunk_id"], r["gain"]) for r in found], f"query_id {kind}, chunk_id {self.id_type}, gain double").unionByName(more)
        bases: dict = {}
        for q, _, w in weights:
            bases[q] = bases.get(q, 0.0) + (0.0 if paper else DELTA * w)
        based = F.broadcast(self.spark.createDataFrame(list(bases.items()), f"query_id {kind}, base double"))
        if not paper and len(least) < len(bases):
            gains = gains.unionByName(self._padding(m, [q for q in bases if q not in least], n, kind))
        final = gains.groupBy("query_id", "chunk_id").agg(F.max("gain").alias("gain")).join(based, "query_id").select("query_id", "chunk_id", F.round(F.col("base") + F.col("gain"), digits).alias("score")).where("score > 0")
        ranked = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
        return ranked.where(F.col("rank") <= n)

    def _asked(self, m: dict, asked: list, terms: set[str] | None = None) -> DataFrame:
        """The posting rows of the terms that are asked for: whole buckets and row groups of others stay unread."""
        if terms is None:
            terms = {r["term"] for r in asked}
        spread, small = [s["name"] for s in m["segments"] if s["spread"]], [s["name"] for s in m["segments"] if not s["spread"]]
        buckets = sorted({r["bucket"] for r in asked if r["term"] in terms})
        where = [F.col("seg").isin(some) & F.col("bucket").isin(list(b)) for some, b in ((spread, buckets), (small, [0])) if some]
        rows = self.postings(m).where(reduce(lambda a, b: a | b, where, F.lit(False)))
        return rows.where(F.col("term").isin(sorted(terms)))

    def _weights(self, m: dict, asked: list) -> list[tuple]:
        """(query_id, term, weight) of the known terms."""
        terms = sorted({r["term"] for r in asked})
        n = sum(s["n"] for s in m["segments"]) - sum(g["n"] for g in m["gone"])
        if not terms or n <= 0:
            return []
        counted = self._asked(m, asked).groupBy("term").agg(F.sum("n").alias("df"))
        if m["gone"]:
            lost = self._table("terms", [g["name"] for g in m["gone"]], "term string, df long, seg string").where(F.col("term").isin(terms))
            counted = counted.unionByName(lost.groupBy("term").agg((-F.sum("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        df = {r["term"]: r["df"] for r in counted.collect()}
        return [(r["query_id"], r["term"], math.log((n + 1.0) / df[r["term"]]) * r["times"]) for r in asked if df.get(r["term"], 0) > 0]

    def _scored(self, m: dict, rows: DataFrame, weighed: DataFrame, blocks, kind: str, paper: bool, mean: float) -> DataFrame:
        """query_id, chunk_id, gain of the live chunks of blocks (query_id, seg, block): a list, whose numbers reach the scan, or a table."""
        docs = self._docs(m)
        if isinstance(blocks, list):
            some = sorted({r["block"] for r in blocks})
            rows, docs = rows.where(F.col("block").isin(some)), docs.where(F.col("block").isin(some))
            blocks = F.broadcast(self.spark.createDataFrame([tuple(r) for r in blocks], f"query_id {kind}, seg string, block long"))
        own = _unpacked(rows.join(weighed, "term").join(blocks, ["query_id", "seg", "block"]), "query_id", "weight").join(docs, ["seg", "block", "at"])
        gain = F.col("weight") * (_gain(F.col("tf"), F.col("dl"), mean) + (DELTA if paper else 0.0))
        return self.live(own, m).groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("gain"))

    def _padding(self, m: dict, queries: list, n: int, kind: str) -> DataFrame:
        """The 2n least live ids, for queries with fewer than n matches: n of them have no match at least."""
        ids = self.live(self._docs(m).select("chunk_id", "seg"), m).select("chunk_id").orderBy("chunk_id").limit(2 * n)
        return ids.select(F.explode(F.array(*[F.lit(q).cast(kind) for q in queries])).alias("query_id"), "chunk_id", F.lit(0.0).alias("gain"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _mean(m: dict) -> float:
    n = sum(s["n"] for s in m["segments"]) - sum(g["n"] for g in m["gone"])
    words = sum(s["words"] for s in m["segments"]) - sum(g["words"] for g in m["gone"])
    return words / n if n else 0.0


def _gain(tf: Column, dl: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)) if mean else F.lit(0.0)


def _unpacked(rows: DataFrame, *more: str) -> DataFrame:
    """A row a chunk: term, seg, block, at, tf."""
    return rows.select("term", "seg", "block", *more, F.explode(F.arrays_zip("ats", "tfs")).alias("p")).select("term", "seg", "block", *more, F.col("p.ats").alias("at"), F.col("p.tfs").alias("tf"))


def _runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """A partition's rows of so many words or some more at once, in whole blocks of chunks but the last."""
    held, n, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            held, n, size = [*held, part], n + part.num_rows, size + len(part["words"].flatten())
            if size >= words or n >= RUN_CHUNKS:
                table, whole = pa.Table.from_batches(held), n // BLOCK * BLOCK
                if whole:
                    yield table.slice(0, whole)
                    held, n = table.slice(whole).to_batches(), n - whole
                    size = sum(len(b["words"].flatten()) for b in held)
    if n:
        yield pa.Table.from_batches(held)


def _posted(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    """Of a partition's chunks (chunk_id, words), in order: a row a chunk, without a term; and a row a run's term, with each of its
    chunks packed: how far it is from the one before, the term's count there, the chunk's length."""
    first = TaskContext.get().partitionId() << (33 - BLOCK_BITS)  # no block spans two partitions
    for table in _runs(batches, run_words):
        words = table["words"].combine_chunks()
        dl = words.value_lengths().to_numpy().astype(np.int32)
        flat, number = words.flatten(), np.arange(len(dl))
        of = np.repeat(number, dl)[flat.is_valid().to_numpy(zero_copy_only=False)]
        coded = flat.drop_null().dictionary_encode()
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | of, return_counts=True)
        code, place = key >> 32, key & 0xFFFFFFFF
        start = np.flatnonzero(np.diff(code, prepend=-1))
        step = np.diff(place, prepend=0)
        step[start] = place[start] & (BLOCK - 1)  # the row's block says the rest
        raw, at = pack(np.stack((step, tf, dl[place]), axis=1).ravel())
        offsets = at[np.append(3 * start, 3 * len(key))].astype(np.int32)
        places = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        yield _rows(len(dl), chunk_id=table["chunk_id"].combine_chunks(), dl=pa.array(dl), at=pa.array(number & (BLOCK - 1), pa.int8()), term=pa.string(), block=pa.array(first + (number >> BLOCK_BITS)), places=pa.binary())
        for i in range(0, len(start), 1 << 14):
            own = slice(i, i + (1 << 14))
            yield _rows(len(start[own]), chunk_id=table["chunk_id"].type, dl=pa.int32(), at=pa.int8(), term=coded.dictionary.take(pa.array(code[start[own]])), block=pa.array(first + (place[start[own]] >> BLOCK_BITS)), places=places[own])
        first += -(-len(dl) // BLOCK)


def _rows(n: int, **columns: pa.Array | pa.DataType) -> pa.RecordBatch:
    """n rows; a column of which only the type is given is null."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, x) if isinstance(x, pa.DataType) else x for x in columns.values()], names=list(columns))


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting rows, a term and block each, of rows (bucket, term, block, places)."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1 << 12):
            batch = whole.slice(i, 1 << 12)
            raw = pa.concat_arrays([batch["places"]])  # its own buffers, from 0 on
            bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            numbers, ends = unpack(np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]])
            row = np.searchsorted(bounds[1:] - bounds[0], ends[2::3])  # of each place
            step, tf, dl = numbers.reshape(-1, 3).T
            first = np.flatnonzero(np.diff(row, prepend=-1))
            total = np.cumsum(step)
            place = total - (total[first] - step[first])[row]
            block = batch["block"].to_numpy()[row] + (place >> BLOCK_BITS)
            start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            lists = pa.array(np.append(start, len(row)), pa.int32())
            of = pa.array(row[start])
            columns = {
                "bucket": batch["bucket"].take(of),
                "term": batch["term"].take(of),
                "block": pa.array(block[start]),
                "n": pa.array(np.diff(np.append(start, len(row))), pa.int32()),
                "max_tf": pa.array(np.maximum.reduceat(tf, start), pa.int32()),
                "min_dl": pa.array(np.minimum.reduceat(dl, start), pa.int32()),
                "ats": pa.ListArray.from_arrays(lists, pa.array(place & (BLOCK - 1), pa.int8())),
                "tfs": pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
