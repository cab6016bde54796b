"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all windows of training words.

Words are the runs matching ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased. A test item's windows
are its runs of `n` words; an item of fewer words, but not none, is one window. A hash hit counts only once the window's
own bytes agree. The benchmark's bytes are counted first: up to `shard_bytes` they are one broadcast; a larger benchmark
goes in shards of that size, each scanned in a pass of its own over a table that is written once, so no task ever holds more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, kernel_columns, new_path, ragged, written
from .textbytes import ALNUM, LOWER, Spans, U, covered, of_texts, window_hashes, window_starts

_LOWER = bytes(LOWER)


class GramIndex:
    """The items' words as one string, and by window size sorted window hashes with first words and item numbers.

    16 bytes a window, besides the text.
    """

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in items]
        data, offsets = of_texts([t for _, t in items])
        spans = Spans(data, offsets, ALNUM)
        self.text = b" ".join(bytes(data[a:b]) for a, b in zip(spans.starts, spans.ends, strict=True)).translate(_LOWER)
        self.at = np.concatenate(([0], np.cumsum(spans.ends - spans.starts + 1)))
        hashes, size_of = spans.hashes(LOWER), np.minimum(n, spans.counts)
        self.sizes = {}
        for size in np.unique(size_of[size_of > 0]).tolist():
            word = window_starts(spans.first, size)
            item = spans.doc[word]
            word, item = word[size_of[item] == size], item[size_of[item] == size]
            keys = window_hashes(hashes, size)[word]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> U(44)).astype(np.int64)] = True
            self.sizes[size] = (seen, keys, word[order].astype(np.int32), item[order].astype(np.int32))

    def scan(self, spans: Spans):
        """Hit words (a mask) and, by text, the item numbers found."""
        hit, found = np.zeros(len(spans), bool), [set() for _ in spans.counts]
        if not len(spans):
            return hit, found
        hashes, doc, data = spans.hashes(LOWER), spans.doc, spans.data
        for size, (seen, keys, words, items) in self.sizes.items():
            at = window_starts(spans.first, size)
            h = window_hashes(hashes, size)[at]
            may = seen[(h >> U(44)).astype(np.int64)]
            at, h = at[may], h[may]
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = high > low
            good = []
            for p, i, j in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                a, b = spans.starts[p : p + size].tolist(), spans.ends[p : p + size].tolist()
                own = b" ".join(bytes(data[x:y]) for x, y in zip(a, b, strict=True)).translate(_LOWER)
                same = {int(items[k]) for k in range(i, j) if self.text[self.at[words[k]] : self.at[words[k] + size] - 1] == own}
                if same:
                    good.append(p)
                    found[doc[p]] |= same
            if good:
                hit |= covered(np.array(good), size, len(spans))
        return hit, found


def shards_of(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> list:
    """Functions that collect the benchmark's rows, each at most shard_bytes of text (or one item), one at a time.

    A benchmark larger than that is written once, in a folder a shard.
    """
    known = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= shard_bytes:
        return [lambda: [tuple(r) for r in known.collect()]]
    n, path = -(-total // shard_bytes) * 2, new_path(benchmark.sparkSession, "benchmark")
    dealt = known.withColumn("_shard", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    dealt.write.partitionBy("_shard").parquet(path)
    table = benchmark.sparkSession.read.schema(dealt.schema).parquet(path)
    return [lambda s=s: [tuple(r) for r in table.where(F.col("_shard") == s).select("i", "t").collect()] for s in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """docs with a struct column of what the benchmark's windows hit; its name is returned in `.decontam_column`.

    An empty table gives no rows. Fields: n_words, n_hit (words inside a hit), hits (positions of hit words), items (ids found, sorted as strings).
    A null or empty text has no words and no hits; an empty benchmark hits nothing; a null item id is left out of `items`
    though its words count as hit; an item_id with more rows than one is one item with the windows of all. Repeated rows are
    judged alike; a text of any length is scanned whole; the input's own columns stay, whatever their names.
    """
    name = fresh("decontam", docs.columns)
    spark = docs.sparkSession
    own = [fresh(f"_d{k}", docs.columns) for k in range(3)]
    fields = [T.StructField(o, kind) for o, kind in zip(own, (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())), strict=True)]
    columns, shards = list(docs.columns), shards_of(benchmark, item_col, item_text_col, shard_bytes)

    def scanned(part: DataFrame, rows, keep: list[str]) -> tuple[DataFrame, object]:
        handle = spark.sparkContext.broadcast(GramIndex(rows(), n))
        return kernel_columns(part, text_col, fields, lambda: _kernel(handle.value), keep), handle

    if len(shards) == 1:
        out, _ = scanned(docs, shards[0], columns)
    else:
        # the texts are written once; a shard's pass leaves hits alone, and the first one the numbers of words
        rid = fresh("_rid", [*columns, *own])
        base = written(docs.withColumn(rid, F.monotonically_increasing_id()), "decontam")
        tables = []
        for k, rows in enumerate(shards):
            part, handle = scanned(base, rows, [rid])
            tables.append(written(part if k == 0 else part.where(F.size(own[1]) > 0), "hits"))
            handle.destroy()  # one shard is in memory at a time
        hits = reduce(DataFrame.unionByName, tables).groupBy(rid).agg(F.max(own[0]).alias(own[0]), *[F.array_distinct(F.flatten(F.collect_list(o))).alias(o) for o in own[1:]])
        out = base.join(hits, rid)
    out = out.select(*columns, F.struct(F.col(own[0]).alias("n_words"), F.size(own[1]).cast("long").alias("n_hit"), F.array_sort(own[1]).alias("hits"), F.array_sort(own[2]).alias("items")).alias(name))
    out.decontam_column = name
    return out


def _kernel(index: GramIndex):
    def kernel(data, offsets, nulls):
        spans = Spans(data, offsets, ALNUM)
        hit, found = index.scan(spans)
        doc = spans.doc
        where = np.flatnonzero(hit)
        within = where - spans.first[doc[where]]
        hits = ragged(within.astype(np.int32), np.bincount(doc[where], minlength=len(spans.counts)), pa.int32())
        items = [sorted({str(index.ids[i]) for i in s if index.ids[i] is not None}) for s in found]
        return [spans.counts, hits, pa.array(items, pa.list_(pa.string()))]

    return kernel


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text")), benchmark, **{**options, "text_col": "text"})
    d = F.col(found.decontam_column)
    return found.select("doc_id", d["n_words"].alias("n_words"), d["n_hit"].alias("n_hit"), F.size(d["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(d["items"], ","), 256).alias("items_sha256"), (d["n_hit"] > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without what the benchmark hits: whole documents, or ("spans") the hit words with what stands between them.

    A null text stays as it is. A document of which nothing remains keeps the empty text.
    """
    found = scan(docs, benchmark, text_col=text_col, **options)
    d = F.col(found.decontam_column)
    if mode == "documents":
        return found.where(d["n_hit"] == 0).select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"mode must be documents or spans, not {mode}")
    cut = F.pandas_udf(_cut, T.StringType())
    return found.select(*[F.when(d["n_hit"] > 0, cut(F.col(c), d["hits"])).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
    out = []
    for text, hit in zip(texts, hits, strict=True):
        if text is None or hit is None or not len(hit):
            out.append(text)
            continue
        data, offsets = of_texts([text])
        spans = Spans(data, offsets, ALNUM)
        raw, parts, last = bytes(data), [], 0
        runs = np.split(np.asarray(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
        for run in runs:
            parts.append(raw[last : spans.starts[run[0]]])
            last = int(spans.ends[run[-1]])
        parts.append(raw[last:])
        out.append(b"".join(parts).decode())
    return pd.Series(out)

