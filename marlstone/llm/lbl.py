"""Log-bilinear language model, trained with noise-contrastive estimation, over counts of the whole corpus.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end a text. The vocabulary are the commonest
words, 2^18 of them up to 2^24 tokens. Of these the commonest 1,022 are classes of the model each; the others lie in
classes of some hundred words that have like neighbours. A token's probability is its class's after the classes of the two
tokens before it, times the word's within its class, both log-bilinear in the same context vector: the two context classes
give one vector, the sum of their projections; its product with the class vectors is normalised over all classes, its
product with the vectors of a class's words (with the logarithms of their counts as biases) over that class. Words outside
the vocabulary share one more class, and have the add-one share of its counted rest, so a text's probability is normalised
over all words. Normalisers are batched matrix products: one table for all pairs of context classes, and one product a
class of words for all its tokens of a batch.

Class vectors: a model fitted to a sample is where all tasks start a pass of noise-contrastive estimation over their own
share of all training texts; the mean of the tasks' models, weighted by tokens, is the model. Which words share a class is
told by their neighbours in all training texts. Word vectors within classes have the counts of all texts as biases, and learn
from all texts in a pass of their own: a task sends the vectors that it has moved, and a word's vector is their mean, weighted by how
often each was moved. So the sample is where the class vectors start, and nothing else. The numbers of words, of classes and of
the sample's texts grow as the fourth root of the corpus's tokens. The vocabulary goes out as one broadcast; other words' counts are joined.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import commonest, fold, kernel_columns, kernel_rows, ragged, sample_rows, written
from .textbytes import LOWER, NOT_SPACE, Spans, U, mix, of_texts, sums_by

#: The end token's hash, not that of any bytes.
END = 0x5EED0FE2D0FE2D01
REST, STOP = 0, 1
LOG10 = np.log(10)


class _Counter:
    """Counts words of a task, merging when many have come; the memory has a bound, whatever the task's share."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.size, self.ends = most, [], 0, 0

    def take(self, data, offsets, nulls):
        h, n = np.unique(Spans(data, offsets, NOT_SPACE).hashes(LOWER), return_counts=True)
        self.ends += len(offsets) - 1
        self.parts.append((h, n))
        self.size += len(h)
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self._out()

    def _merge(self):
        h = np.concatenate([p[0] for p in self.parts])
        n = np.concatenate([p[1] for p in self.parts])
        h, at = np.unique(h, return_inverse=True)
        self.parts = [(h, np.bincount(at, n).astype(np.int64))]
        self.size = len(h)

    def _out(self):
        for h, n in self.parts:
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["h", "n"])
        self.parts, self.size = [], 0

    def finish(self):
        if self.parts:
            self._merge()
            yield from self._out()
        if self.ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([self.ends], pa.int64())], names=["h", "n"])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h (hash of the word), c over all texts; the end token counts once a text."""
    return kernel_rows(docs, text_col, "h long, n long", _Counter).groupBy("h").agg(F.sum("n").alias("c"))


@dataclass
class LogBilinear:
    """Class vectors q, biases b, and the context's two projected vectors p1 (word before) and p2 (the one before that)."""

    words: np.ndarray  # hashes, by class - 2
    q: np.ndarray
    b: np.ndarray
    p1: np.ndarray
    p2: np.ndarray

    def tables(self):
        """Scores of each class after each context class, and the log normaliser of each pair of them."""
        return (self.p1 @ self.q.T + self.b).astype(np.float32), (self.p2 @ self.q.T).astype(np.float32), self.normalisers()

    def normalisers(self) -> np.ndarray:
        """The log normaliser of each pair of context classes, made in blocks of rows."""
        s2 = self.p2 @ self.q.T
        top2 = s2.max(1)
        e2, out = np.exp(s2 - top2[:, None]).T, np.empty((len(self.b), len(self.b)), np.float32)
        for i in range(0, len(self.b), 512):
            s1 = self.p1[i : i + 512] @ self.q.T + self.b
            top1 = s1.max(1, keepdims=True)
            out[i : i + 512] = np.log(np.maximum(np.exp(s1 - top1) @ e2, 1e-30)) + top1 + top2  # a sum over all classes, for all pairs
        return out


class Nce:
    """Noise-contrastive estimation with unigram noise and Adagrad; streams hold the classes of one text each."""

    def __init__(self, freq: np.ndarray, model: dict, grad: dict, noise: int = 8, rate: float = 0.15, seed: int = 1):
        self.rng, self.noise, self.rate, self.shared = np.random.default_rng(seed), noise, rate, 8 * noise  # noise words of a batch, drawn once for all of it
        p = (freq + 1.0) / (freq + 1.0).sum()
        self.model, self.grad, self.seen = model, grad, 0
        self.logkp, self.cdf = np.log(noise * p).astype(np.float32), np.cumsum(p)

    @classmethod
    def begin(cls, freq: np.ndarray, dim: int = 32, noise: int = 8, rate: float = 0.15, seed: int = 1) -> Nce:
        own = cls(freq, {}, {}, noise, rate, seed)
        rng, v, p = own.rng, len(freq), (freq + 1.0) / (freq + 1.0).sum()
        model = {"q": rng.normal(0, 0.1, (v, dim)), "b": np.log(p), "p1": rng.normal(0, 0.1, (v, dim)), "p2": rng.normal(0, 0.05, (v, dim))}
        own.model = {k: x.astype(np.float32) for k, x in model.items()}
        own.grad = {k: np.full_like(x, 1e-2) for k, x in own.model.items()}
        return own

    def _step(self, at: np.ndarray, **gradients: np.ndarray) -> None:
        """Adds gradients by row of the tables that they are named for; rows may repeat."""
        order = np.argsort(at.astype(np.int16) if len(self.logkp) < 1 << 15 else at, kind="stable")
        rows = at[order]
        start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rows = rows[start]
        for name, g in gradients.items():
            total = np.add.reduceat(g.take(order, 0), start)
            squares = self.grad[name].take(rows, 0) + total * total
            self.grad[name][rows] = squares
            self.model[name][rows] -= self.rate * total / np.sqrt(squares)

    def learn(self, data: np.ndarray) -> None:
        """One pass over rows of a class and the two before it."""
        q, bias, p1, p2 = (self.model[k] for k in ("q", "b", "p1", "p2"))
        shared, logkp = self.shared, self.logkp
        order, v, columns = self.rng.permutation(len(data)), len(logkp), np.ascontiguousarray(data.T)
        self.seen += len(data)
        for i in range(0, len(order), 4096):
            w, a, b = columns.take(order[i : i + 4096], 1)
            h = p1.take(a, 0)
            h += p2.take(b, 0)
            n = np.minimum(np.searchsorted(self.cdf, self.rng.random(shared)), v - 1)  # shared by the batch
            qw, qn = q.take(w, 0), q[n]
            gt = np.exp(logkp[w] - np.einsum("ij,ij->i", h, qw) - bias[w])
            gt = -gt / (1 + gt)
            go = h @ qn.T  # in place from here on: the largest array of a batch
            go += bias[n] - logkp[n]
            np.exp(np.minimum(go, 30, out=go), out=go)
            go /= go + 1
            go *= np.float32(self.noise / shared)
            m = np.float32(len(w) ** -0.5)
            gh = gt[:, None] * qw
            gh += go @ qn
            gh *= m
            self._step(w, q=(gt * m)[:, None] * h, b=gt * m)
            self._step(n, q=go.T @ h * m, b=go.sum(0) * m)
            self._step(a, p1=gh)
            self._step(b, p2=gh)

    def made(self, words: np.ndarray) -> LogBilinear:
        m = self.model
        return LogBilinear(words, m["q"], m["b"], m["p1"], m["p2"])


def train_nce(streams: list[np.ndarray], words: np.ndarray, freq: np.ndarray, dim: int = 32, noise: int = 8, epochs: int = 4, rate: float = 0.15, seed: int = 1) -> Nce:
    """A model of some streams, `epochs` times over."""
    nce = Nce.begin(freq, dim, noise, rate, seed)
    rows = [np.column_stack([s, np.concatenate(([STOP], s[:-1])), np.concatenate(([STOP, STOP], s[:-2]))[: len(s)]]) for s in streams if len(s)]
    data = np.concatenate(rows) if rows else np.zeros((0, 3), int)
    for _ in range(epochs):
        nce.learn(data)
    return nce


def with_ends(cls: np.ndarray, spans: Spans):
    """Each text's classes and its end, one after another; the two classes before each; and where the texts begin."""
    n = len(spans.counts)
    flat = np.full(len(cls) + n, STOP, np.int64)
    flat[np.arange(len(cls)) + spans.doc] = cls
    first = spans.first + np.arange(n + 1)
    before = np.concatenate(([STOP], flat[:-1]))
    before[first[:-1]] = STOP
    second = np.concatenate(([STOP], before[:-1]))
    second[first[:-1]] = STOP
    return flat, before, second, first


#: Numbers of the model in a row of what a task has learned.
BLOCK = 1 << 12


class _Learner:
    """A task's pass over all its texts, from where the others start, too; in the end its parameters, times its tokens."""

    def __init__(self, start: Nce, sorted_words: np.ndarray, numbers: np.ndarray):
        self.nce = copy.deepcopy(start)
        self.nce.seen, self.words, self.numbers = 0, sorted_words, numbers

    def take(self, data, offsets, nulls):
        spans = Spans(data, offsets, NOT_SPACE)
        self.nce.learn(np.column_stack(with_ends(class_of(spans.hashes(LOWER), self.words, self.numbers), spans)[:3]))

    def finish(self):
        if self.nce.seen:
            flat = np.concatenate([x.ravel() for x in self.nce.model.values()]).astype(np.float64) * self.nce.seen
            cut = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array([self.nce.seen] * len(cut), pa.int64()), ragged(flat, [len(c) for c in cut], pa.float64())], names=["block", "n", "x"])


def _total(table: pa.Table) -> pa.Table:
    total = np.sum(np.stack(table["x"].to_pylist()), axis=0)
    return pa.table({"block": table["block"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "x": pa.array([total.tolist()], pa.list_(pa.float64()))})


def learn_all(docs: DataFrame, start: Nce, sorted_words: np.ndarray, numbers: np.ndarray, text_col: str = "text") -> Nce:
    """One pass over all texts from `start`, each task over its own, then the tasks' mean, weighted by tokens."""
    handle = docs.sparkSession.sparkContext.broadcast((start, sorted_words, numbers))
    learned = kernel_rows(docs, text_col, "block long, n long, x array<double>", lambda: _Learner(*handle.value))
    rows = learned.groupBy("block").applyInArrow(_total, "block long, n long, x array<double>").collect()
    out = copy.deepcopy(start)
    if rows:
        flat = np.concatenate([np.array(r["x"]) / r["n"] for r in sorted(rows, key=lambda r: r["block"])])
        ends = np.cumsum([x.size for x in out.model.values()])
        out.model = {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(out.model.items(), np.split(flat, ends[:-1]), strict=True)}
        out.seen = rows[0]["n"]
    return out


def growth(tokens: int, grow: int) -> float:
    """How many times its base size what grows with the corpus has."""
    return max(1.0, (tokens / grow) ** 0.25)


#: Words in a row of what a task has found of them.
SHARD = 1 << 8


def _shards(at: np.ndarray, weight: np.ndarray, x: np.ndarray):
    """Rows of a task: by shards of words the words' places there, weights and vectors; at ascends."""
    task = TaskContext.get()
    part, cut = task.partitionId() if task else 0, np.flatnonzero(np.diff(at // SHARD, prepend=-1, append=-1))
    for some in (cut[i : i + 257] for i in range(0, len(cut) - 1, 256)):
        ranges = list(zip(some, some[1:], strict=False))
        columns = [np.ascontiguousarray(c) for c in ((at % SHARD).astype(np.uint8), weight.astype(np.float32), x)]
        yield pa.RecordBatch.from_arrays([pa.array([int(at[i]) // SHARD for i, _ in ranges], pa.int64()), pa.array([part] * len(ranges), pa.int32()), *[pa.array([c[i:j].tobytes() for i, j in ranges], pa.binary()) for c in columns]], names=["shard", "part", "at", "w", "x"])


SHARDS = "shard long, part int, at binary, w binary, x binary"


def _summed(rows: DataFrame, n: int, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Of the tasks' rows the weighted sum of each of n words' vectors, and of their weights; tasks are summed in their order."""

    def total(table: pa.Table) -> pa.Table:
        out = np.zeros((SHARD, dim + 1))
        for row in table.sort_by("part").to_pylist():
            at, w = np.frombuffer(row["at"], np.uint8), np.frombuffer(row["w"], np.float32).astype(np.float64)
            out[at, :dim] += np.frombuffer(row["x"], kind).reshape(-1, dim) * w[:, None]
            out[at, dim] += w
        return pa.table({"shard": table["shard"][:1], "x": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    found = rows.groupBy("shard").applyInArrow(total, "shard long, x binary").toArrow()
    out = np.zeros((-(-n // SHARD) * SHARD, dim + 1), np.float32)
    for k, x in zip(found["shard"].to_pylist(), found["x"], strict=True):
        out[k * SHARD : (k + 1) * SHARD] = np.frombuffer(x.as_buffer(), np.float32).reshape(SHARD, dim + 1)
    return out[:n, :dim], out[:n, dim]


class _Near:
    """For each of n words the sum of random vectors of the single words next to it. The vectors are of whole numbers, so the sums
    are the same in any order. Texts are places in the vocabulary, -1 for other words."""

    def __init__(self, n: int, singles: np.ndarray, dim: int = 16, seed: int = 2):
        self.n, self.single = n, len(singles)
        self.number = np.full(n + 1, self.single)
        self.number[singles] = np.arange(self.single)
        self.vectors = np.random.default_rng(seed).integers(-8, 9, (2, self.single, dim)).astype(np.float32)
        self.points = np.zeros((dim, n))

    def add(self, flat: np.ndarray) -> None:
        for side, (word, other) in enumerate(((flat[1:], flat[:-1]), (flat[:-1], flat[1:]))):
            near = self.number[other]
            own = np.flatnonzero((near < self.single) & (word >= 0) & (self.number[word] == self.single))
            word, near = word[own], self.vectors[side][near[own]]
            for d, points in enumerate(self.points):
                points += np.bincount(word, near[:, d], self.n)


class _NearTask(_Near):
    def __init__(self, hashes: np.ndarray, singles: np.ndarray):
        super().__init__(len(hashes), singles)
        self.hashes = hashes

    def take(self, data, offsets, nulls):
        spans = Spans(data, offsets, NOT_SPACE)
        at, hit = found(self.hashes, spans.hashes(LOWER))
        flat = np.full(len(at) + len(spans.counts), -1)
        flat[np.arange(len(at)) + spans.doc] = np.where(hit, at, -1)
        self.add(flat)

    def finish(self):
        at = np.flatnonzero(self.points.any(0))
        yield from _shards(at, np.ones(len(at)), self.points[:, at].T.astype(np.int32))


def near_all(docs: DataFrame, hashes: np.ndarray, singles: np.ndarray, text_col: str = "text", dim: int = 16) -> np.ndarray:
    """The sums of _Near over all texts, a row a word."""
    handle = docs.sparkSession.sparkContext.broadcast((hashes, singles))
    return _summed(kernel_rows(docs, text_col, SHARDS, lambda: _NearTask(*handle.value)), len(hashes), dim, np.int32)[0]


def alike(streams: list[np.ndarray], n: int, singles: np.ndarray, size: int = 512) -> np.ndarray:
    """grouped() of texts that are at hand, as places in the vocabulary, -1 for other words."""
    near = _Near(n, singles)
    near.add(np.concatenate([np.append(s, -1) for s in streams]) if streams else np.zeros(0, np.int64))
    return grouped(near.points.T, singles, size)


def grouped(points: np.ndarray, singles: np.ndarray, size: int = 512, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """Groups, from 0, of the words of a vocabulary that are not among `singles` (-1 for these), of 2 x size words at most.

    points has a row a word, as _Near sums them; k-means brings alike ones together. Words that no single word is next to are one
    group before the large ones are cut; words are cut in the vocabulary's order.
    """
    n, rng = len(points), np.random.default_rng(seed)
    rest = np.setdiff1d(np.arange(n), singles)
    points = points[rest].astype(np.float32)
    length = np.sqrt((points * points).sum(1))
    seen = length > 0
    points[seen] /= length[seen, None]
    group = np.zeros(len(rest), np.int64)
    k = max(1, -(-len(rest) // size))
    if seen.any() and k > 1:
        own = points[seen]
        centres = own[rng.choice(len(own), min(k, len(own)), replace=False)]
        for _ in range(rounds):
            near = np.concatenate([(own[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(own), 8192)])
            centres = np.column_stack([np.bincount(near, own[:, d], len(centres)) for d in range(own.shape[1])])
            centres = (centres / np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)).astype(np.float32)
        group[seen] = near + 1
    # groups too large are cut
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], group[order])
    piece = np.stack([group[order], (np.arange(len(order)) - start) // (2 * size)])
    _, cut = np.unique(piece, axis=1, return_inverse=True)
    out = np.full(n, -1)
    out[rest[order]] = cut.ravel()
    return out


@dataclass
class Words:
    """The vocabulary: sorted hashes, counts, classes, and by class (in `order`) the words' vectors and logarithms of counts."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    place: np.ndarray  # of each word in class order
    begin: np.ndarray  # of each class in class order
    vectors: np.ndarray
    bias: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, n_classes: int, dim: int) -> Words:
        order = np.argsort(classes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin = np.searchsorted(classes[order], np.arange(n_classes + 1))
        return cls(hashes, counts, classes, place, begin, np.zeros((len(order), dim), np.float32), np.log(np.maximum(counts[order], 1)).astype(np.float32))

    def many(self) -> np.ndarray:
        """Which classes have more than one word."""
        return np.diff(self.begin) > 1

    def learn(self, place: np.ndarray, classes: np.ndarray, context, grad: np.ndarray, moved: np.ndarray, rng: np.random.Generator, noise: int = 8, shared: int = 64, rate: float = 0.1) -> None:
        """Noise-contrastive estimation over tokens of classes of many words, a step a class; context(rows) gives the context
        vectors of some. Noise words are drawn by count, so a vector of zeros is where the counts alone say it all. moved counts how
        often a word was met, or stood for noise."""
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.bias.astype(np.float64)))))
        ln = np.float32(np.log(noise))  # of the vectors' kind, or all that follows would be twice as wide
        todo = np.argsort(classes, kind="stable")
        bounds = np.flatnonzero(np.diff(classes[todo], prepend=-1, append=-1))
        for i, j in zip(bounds, bounds[1:], strict=False):
            a, b = self.begin[classes[todo[i]]], self.begin[classes[todo[i]] + 1]
            for k in range(i, j, 2048):
                own = todo[k : min(j, k + 2048)]
                w, h = place[own], context(own)
                drawn = np.clip(np.searchsorted(total, total[a] + rng.random(shared) * (total[b] - total[a]), "right") - 1, a, b - 1)
                # the model's and the noise's logits differ by the product with the vector alone
                gt = np.exp(np.minimum(np.einsum("ij,ij->i", h, self.vectors.take(w, 0)) - ln, 80))
                gt = -1 / (1 + gt)
                go = h @ self.vectors.take(drawn, 0).T
                np.exp(np.minimum(np.subtract(ln, go, out=go), 80, out=go), out=go)
                go += 1
                np.divide(np.float32(noise / shared), go, out=go)
                at = np.concatenate([w, drawn]) - a
                n = np.bincount(at)
                rows = np.flatnonzero(n)
                each = np.concatenate([gt[:, None] * h, go.T @ h])
                by = np.argsort(at.astype(np.int16) if b - a < 1 << 15 else at, kind="stable")
                step = np.add.reduceat(each.take(by, 0), np.cumsum(n[rows]) - n[rows])
                weight = n.astype(np.float64)
                weight += np.bincount(drawn - a, minlength=len(n)) * (len(own) * noise / shared - 1)
                rows += a
                moved[rows] += weight[rows - a]
                squares = grad.take(rows, 0) + step * step
                grad[rows] = squares
                self.vectors[rows] -= rate * step / np.sqrt(squares)

    def within(self, place: np.ndarray, classes: np.ndarray, context, room: int = 1 << 21) -> np.ndarray:
        """The log probability of each word within its class; context(rows) gives the context vectors of some."""
        out = np.zeros(len(place))
        todo = np.flatnonzero(self.many()[classes])
        todo = todo[np.argsort(classes[todo], kind="stable")]
        bounds = np.flatnonzero(np.diff(classes[todo], prepend=-1, append=-1))
        for i, j in zip(bounds, bounds[1:], strict=False):
            c = classes[todo[i]]
            a, b = self.begin[c], self.begin[c + 1]
            vectors, bias, step = self.vectors[a:b].astype(np.float32).T, self.bias[a:b], max(1, room // int(b - a))
            for k in range(i, j, step):
                own = todo[k : min(j, k + step)]
                x = context(own) @ vectors
                x += bias
                target = x[np.arange(len(own)), place[own] - a].astype(np.float64)
                top = x.max(1, keepdims=True)
                x -= top
                np.exp(x, out=x)
                out[own] = target - top[:, 0] - np.log(x.sum(1))
        return out


def class_of(hashes: np.ndarray, sorted_words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    at, hit = found(sorted_words, hashes)
    return np.where(hit, classes[at], REST) if len(sorted_words) else np.zeros(len(hashes), np.int64)


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_tokens", "hot_known", "n_rest")] + [T.StructField(n, T.DoubleType()) for n in ("hot_log", "model_log")] + [T.StructField("tail", T.ArrayType(T.LongType())), T.StructField("tail_n", T.ArrayType(T.IntegerType()))]


@dataclass
class Model:
    """All that scoring needs: the vocabulary, class vectors, projections of contexts, normalisers, and the end's count."""

    words: Words
    q: np.ndarray
    b: np.ndarray
    p1: np.ndarray
    p2: np.ndarray
    z: np.ndarray
    ends: int

    def logs(self, at: np.ndarray, known: np.ndarray, spans: Spans):
        """Of words by places in the vocabulary (if known): the tokens' log probabilities by text and class, an outside word's
        that of its class alone; where texts begin among the tokens."""
        own = np.where(known, at, 0) if len(self.words.classes) else np.zeros(len(at), np.int64)
        cls = np.where(known, self.words.classes[own], REST) if len(self.words.classes) else np.full(len(at), REST)
        flat, before, second, first = with_ends(cls, spans)
        token = np.flatnonzero(known)  # words' tokens come a place later for each text before theirs
        spot = np.arange(len(at)) + spans.doc
        h = self.p1.take(before, 0)
        h += self.p2.take(second, 0)
        out = (np.einsum("ij,ij->i", h, self.q.take(flat, 0)) + self.b[flat] - self.z[before, second]).astype(np.float64)
        if len(token):
            a, b = before[spot[token]], second[spot[token]]
            context = lambda rows: self.p1.take(a[rows], 0) + self.p2.take(b[rows], 0)
            out[spot[token]] += self.words.within(self.words.place[own[token]], cls[token], context)
        return out / LOG10, cls, first


def found(hashes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's place among the sorted ones, which differ, and whether it is there; the place of one that is not means nothing.

    Hashes are spread evenly, so their first bits tell the place but for a few; where they are not, they are searched for.
    """
    if not len(hashes):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    shift = U(64 - len(hashes).bit_length())
    n = np.bincount((hashes >> shift).astype(np.int64), minlength=1 << len(hashes).bit_length())
    if n.max() > 32:
        at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
        return at, hashes[at] == x
    end, cell = np.cumsum(n), (x >> shift).astype(np.int64)
    last = end.take(cell) - 1
    at = last - n.take(cell) + 1  # an empty cell's place is the next cell's, whose hashes differ
    np.minimum(at, len(hashes) - 1, out=at)
    hit = hashes.take(at) == x
    more = np.flatnonzero(~hit & (at < last))
    while len(more):
        at[more] += 1
        hit[more] = hashes.take(at[more]) == x[more]
        more = more[~hit[more] & (at[more] < last[more])]
    return at, hit


class _WordLearner:
    """A task's pass over all its texts for the words' vectors within classes, in portions of `most` tokens."""

    def __init__(self, words: Words, p1: np.ndarray, p2: np.ndarray, most: int = 1 << 19):
        self.words = replace(words, vectors=np.zeros((len(words.hashes), p1.shape[1]), np.float32))
        self.p1, self.p2, self.many, self.most, self.parts, self.size = p1, p2, words.many(), most, [], 0
        self.grad, self.moved, self.rng = np.full(self.words.vectors.shape, 1e-2, np.float32), np.zeros(len(words.hashes)), np.random.default_rng(4)

    def take(self, data, offsets, nulls):
        spans, w = Spans(data, offsets, NOT_SPACE), self.words
        at, hit = found(w.hashes, spans.hashes(LOWER))
        cls = np.where(hit, w.classes[at], REST)
        _, before, second, _ = with_ends(cls, spans)
        token = np.flatnonzero(hit & self.many[cls])
        spot = token + spans.doc[token]
        self.parts.append(np.stack([w.place[at[token]], cls[token], before[spot], second[spot]]).astype(np.int32))
        self.size += len(token)
        if self.size > self.most:
            self._learn()

    def _learn(self) -> None:
        if self.parts:
            place, cls, a, b = np.concatenate(self.parts, 1)
            self.words.learn(place, cls, lambda rows: self.p1.take(a[rows], 0) + self.p2.take(b[rows], 0), self.grad, self.moved, self.rng)
        self.parts, self.size = [], 0

    def finish(self):
        self._learn()
        at = np.flatnonzero(self.moved)
        yield from _shards(at, self.moved[at], self.words.vectors[at].astype(np.float16))


def learn_words(docs: DataFrame, words: Words, p1: np.ndarray, p2: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The words' vectors in class order after one pass over all texts, the mean of the tasks', and how often each was moved."""
    handle = docs.sparkSession.sparkContext.broadcast((replace(words, vectors=words.vectors[:0]), p1, p2))
    total, moved = _summed(kernel_rows(docs, text_col, SHARDS, lambda: _WordLearner(*handle.value)), len(words.hashes), p1.shape[1], np.float16)
    return (total / np.maximum(moved, 1e-9)[:, None]).astype(np.float16), moved


def fit(learn: DataFrame, h: np.ndarray, c: np.ndarray, total: int, classes: int = 1024, size: int = 256, sample_docs: int = 2048, sample_chars: int = 8_000, start_docs: int = 800, dim: int = 32, grow: int = 1 << 24) -> Model:
    """A model of learn(doc_id, text) whose vocabulary is h, with the counts c; total counts all tokens."""
    more = growth(total, grow)
    ends = int(c[h == U(END)].sum())
    h, c = h[h != U(END)], c[h != U(END)]
    rank = np.lexsort((h, -c))
    singles = rank[: int(classes * more) - 2]
    places = []
    for row in sample_rows(learn, ["doc_id"], F.lit(0), int(sample_docs * more), sample_chars, ["text"])[:start_docs]:
        at, hit = found(h, Spans(*of_texts([row["text"]]), NOT_SPACE).hashes(LOWER))
        places.append(np.where(hit, at, -1).astype(np.int32))
    group = grouped(near_all(learn, h, singles), singles, size) if len(h) else np.zeros(0, np.int64)
    of = np.full(len(h), REST)
    of[singles] = 2 + np.arange(len(singles))
    of[group >= 0] = 2 + len(singles) + group[group >= 0]
    n_classes = 2 + len(singles) + int(group.max(initial=-1)) + 1
    words = Words.of(h, c, of, n_classes, dim)
    freq = np.bincount(of, c, n_classes).astype(np.float64)
    freq[STOP], freq[REST] = ends, total - c.sum() - ends
    streams = [np.append(np.where(p >= 0, of[p], REST) if len(h) else np.full(len(p), REST), STOP) for p in places]
    model = learn_all(learn, train_nce(streams, h, freq, dim), h, of).made(h)
    out = Model(words, model.q, model.b, model.p1, model.p2, model.normalisers(), ends)
    if words.many().any():
        words.vectors, _ = learn_words(learn, words, model.p1, model.p2)
    words.vectors = words.vectors.astype(np.float16)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, hot: int = 1 << 18, grow: int = 1 << 24, **options) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_model.

    Learns from all the rows whose id's crc32 modulo `modulus` isn't `held`: counts, classes and
    all vectors from all of them; start_docs of a sample of sample_docs texts, of a longer one a passage of sample_chars characters, give
    the class vectors' start. `hot` words are the vocabulary; it, the classes and the sample have these sizes up
    to `grow` tokens, and grow with their fourth root. n_model counts the tokens that are in the vocabulary (an end is).
    Null and empty texts are one end token; a text of any length is scored whole; a null id is in fold 0; repeated rows count
    and are scored each; of words of one count the one with the lesser hash is the commoner; with no rows at all the result
    is empty, with no training rows every word is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", fold(F.col("doc_id"), modulus) == held)
    learn = docs.where(~F.col("held_out"))
    counts = written(count_words(learn), "lbl-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    h, c, rare = commonest(counts, int(hot * growth(total, grow)))
    model = fit(learn, h, c, int(total), grow=grow, **options)
    ends = model.ends
    rest_n, rest_v = int(total - model.words.counts.sum() - ends), int(distinct - len(model.words.hashes) - (ends > 0))
    handle = spark.sparkContext.broadcast(model)

    def make():
        model = handle.value
        h = model.words.hashes
        logc = np.log10(model.words.counts + 1.0)
        end_log = np.log10(model.ends + 1.0)

        def kernel(data, offsets, nulls):
            spans = Spans(data, offsets, NOT_SPACE)
            x, doc, n = spans.hashes(LOWER), spans.doc, len(spans.counts)
            at, is_hot = found(h, x)
            log = np.zeros(len(x))
            log[is_hot] = logc[at[is_hot]]
            logp, cls, first = model.logs(at, is_hot, spans)
            tail = np.flatnonzero(~is_hot)
            key = mix(x[tail] ^ mix(doc[tail].astype(np.uint64)))
            _, where, times = np.unique(key, return_index=True, return_counts=True)
            back = np.argsort(tail[where])
            where, times = tail[where][back], times[back]
            per = np.bincount(doc[where], minlength=n)
            return [
                spans.counts + 1,
                sums_by(spans.first, is_hot.astype(np.int64)) + (model.ends > 0),
                sums_by(spans.first, (~is_hot).astype(np.int64)),
                sums_by(spans.first, log) + end_log,
                sums_by(first, logp),
                ragged(x[where].view(np.int64), per, pa.int64()),
                ragged(times.astype(np.int32), per, pa.int32()),
            ]

        return kernel

    # a class's words are scored a slice at a time, so larger slices save steps
    made = kernel_columns(docs, "text", FIELDS, make, ["doc_id", "held_out"], 1 << 22)
    made = written(made.withColumn("rid", F.monotonically_increasing_id()), "lbl-scores")
    tail = made.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("rid", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("n"))
    sums = tail.join(rare, "h").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0) * F.col("n")).alias("tail_log"), F.sum("n").alias("tail_known"))
    zero = F.lit(0.0)
    out = made.drop("tail", "tail_n").join(sums, "rid", "left")
    tail_log = F.coalesce("tail_log", zero)
    whole, rest = float(np.log10(total + distinct + 1.0)), float(np.log10(rest_n + rest_v + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_log") + tail_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model_log") + tail_log - F.col("n_rest") * rest).alias("score"),
        (F.col("n_tokens") - F.col("n_rest")).alias("n_model"),
    )
