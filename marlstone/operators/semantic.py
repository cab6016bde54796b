"""An embedding learned from the corpus: shifted positive pointwise mutual information of words, factorised.

Spark counts words and the pairs that stand within a window, each task summing its own first. The matrix of associations stays a table;
its leading eigenvectors come from products with thin blocks of random vectors, row sums that tasks make and Spark adds up.
Only what is as large as the vocabulary (a parameter) times the dimension is ever on the driver. A text is the sum of its
words' vectors, rare words weighing more, without the direction that all texts share, at unit length.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


class SemanticEmbedder:
    """An Embedder: words' vectors, their weights and the direction that is taken out. Words it does not know add nothing."""

    def __init__(self, words: list[str], vectors: np.ndarray, weights: np.ndarray, common: np.ndarray, stamp: str = ""):
        self.name, self.dim = f"ppmi-{vectors.shape[1]}{stamp}", vectors.shape[1]
        self.at = {w: k for k, w in enumerate(words)}
        self.vectors, self.weights, self.common = vectors.astype(np.float32), weights.astype(np.float32), common.astype(np.float32)

    def plain(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            found = Counter(self.at[w] for w in words_of(text) if w in self.at)
            if found:
                k, n = np.fromiter(found, np.int64), np.fromiter(found.values(), np.float32)
                row += (n * self.weights[k]) @ self.vectors[k] / n.sum()
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        out = self.plain(texts)
        out -= np.outer(out @ self.common, self.common)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = 20_000, least: int = 3) -> list[tuple[str, int]]:
    """The `most` commonest words that occur `least` times or more, with their counts over all texts, commonest first."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\w+"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [(r["w"], r["n"]) for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()]


def pair_counts(docs: DataFrame, vocab: list[str], text_col: str = "text", window: int = 5, hold: int = 1 << 21) -> DataFrame:
    """a, b, n: how often vocabulary words a and b (by place, both ways) stand within `window` words, over all texts."""
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocab)})
    size = len(vocab)

    def run(batches):
        at, keys, held = sent.value, [], 0

        def flush():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.fromiter((at.get(w, -1) for w in words_of(text)), np.int64)
                for d in range(1, window + 1):
                    x, y = ids[:-d], ids[d:]
                    both = (x >= 0) & (y >= 0)
                    x, y = x[both], y[both]
                    keys.append(np.minimum(x, y) * size + np.maximum(x, y))
                    held += len(x)
                if held > hold:
                    yield flush()
                    keys, held = [], 0
        if held:
            yield flush()

    # a pair is counted one way round, and told both ways; of a word with itself these are one row
    once = docs.select(text_col).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return once.select(F.explode(ways).alias("p")).select("p.*")


def associations(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """a, b, v: log of how much more often than by chance a pair occurs, less log(shift), where that is positive."""
    sums = pairs.groupBy("a").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s")).scalar()
    left, right = sums.withColumnRenamed("s", "sa"), sums.select(F.col("a").alias("b"), F.col("s").alias("sb"))
    v = F.log(F.col("n") * F.col("t") / (F.col("sa").cast("double") * F.col("sb"))) - float(np.log(shift))
    return pairs.join(left, "a").join(right, "b").withColumn("t", total).select("a", "b", v.alias("v")).where("v > 0")


def product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """matrix (a, b, v) times a block of vectors: tasks sum the rows that they hold, Spark adds the sums."""
    sent = matrix.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        x = sent.value
        total = np.zeros_like(x)
        for batch in batches:
            a, b, v = (batch.column(k).to_numpy() for k in range(3))
            for k in range(0, len(a), 1 << 14):
                order = np.argsort(a[k : k + (1 << 14)], kind="stable")
                rows = x[b[k : k + (1 << 14)][order]] * v[k : k + (1 << 14)][order, None]
                own = a[k : k + (1 << 14)][order]
                head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[head]] += np.add.reduceat(rows, head)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in total[some]], pa.binary())], names=["a", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(r.as_py()) for r in table["row"]], axis=0)
        return pa.table([table["a"][:1], pa.array([rows.tobytes()], pa.binary())], names=["a", "row"])

    found = matrix.mapInArrow(run, "a int, row binary").groupBy("a").applyInArrow(add, "a int, row binary").toArrow()  # as many rows as words
    out = np.zeros_like(block)
    if found.num_rows:
        out[found["a"].to_numpy()] = np.frombuffer(b"".join(found["row"].to_pylist())).reshape(found.num_rows, -1)
    sent.destroy()
    return out


def factors(matrix: DataFrame, size: int, dim: int, rounds: int = 2, extra: int = 10, seed: int = 3) -> np.ndarray:
    """Rows of the leading eigenvectors of a symmetric matrix, times the roots of their values (the positive ones)."""
    k = min(size, dim + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, k)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(matrix, q))[0]
    values, turn = np.linalg.eigh(q.T @ product(matrix, q))
    best = np.argsort(-values)[:dim]
    out = np.zeros((size, dim))
    out[:, : len(best)] = (q @ turn[:, best]) * np.sqrt(np.maximum(values[best], 0))
    return out


def fit(docs: DataFrame, path: str, text_col: str = "text", dim: int = 64, most: int = 20_000, window: int = 5, shift: float = 1.0, smooth: float = 1e-3, sample: int = 4096, id_col: str = "doc_id") -> SemanticEmbedder:
    """An embedder of the corpus; the table of associations is written under path. Texts without a known word are zero vectors. The
    shared direction is that of `sample` texts by id hash; all else counts every text."""
    spark = docs.sparkSession
    counted = vocabulary(docs, text_col, most)
    words = [w for w, _ in counted]
    if not words:
        return SemanticEmbedder([], np.zeros((0, dim)), np.zeros(0), np.zeros(dim))
    associations(pair_counts(docs, words, text_col, window), shift).write.parquet(path)
    vectors = factors(spark.read.schema("a int, b int, v double").parquet(path), len(words), dim)
    share = np.array([n for _, n in counted]) / sum(n for _, n in counted)
    made = SemanticEmbedder(words, vectors, smooth / (smooth + share), np.zeros(dim))
    n = docs.count()
    texts = [r[0] for r in docs.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, n // sample))) == 0).select(text_col).limit(2 * sample).collect()]
    x = made.plain(texts)
    if len(x) > 1:
        made.common = np.linalg.eigh(x.T.astype(np.float64) @ x)[1][:, -1].astype(np.float32)
    return made


def halves(text: Column) -> tuple[Column, Column]:
    """The first and the second half of a text's words, in small letters."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    at = (F.size(w) / 2).cast("int")
    return F.array_join(F.slice(w, F.lit(1), at), " "), F.array_join(F.slice(w, at + 1, F.size(w)), " ")
