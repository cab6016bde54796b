"""Toxicity: non-negative positive-unlabelled learning of a numpy classifier.

Confirmed toxic documents are the positives; all texts of the learning folds, labelled or not, are the unlabelled. The
risk is prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)) with the logistic loss; where the bracket is negative the step
goes the other way (Kiryo et al. 2017). The features are the words and word parts that stand out among the positives;
how common they are among the unlabelled is counted over all texts of the learning folds. The descent uses bounded samples, whose
bounds are parameters; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold, fresh, kernel_columns, kernel_rows, sample_rows
from .textbytes import LETTERS, LOWER, Spans, U, mix, of_texts

_M = U(0x9E3779B97F4A7C15)
PREFIXES = (4, 5, 6, 7, 8)
#: A feature counts once, twice and thrice: a stem that clean texts have by chance is frequent in toxic ones.
LEVELS = 3


def keys_of(spans: Spans):
    """Kinds of feature keys of the words (64-bit), each with the word it stands for: whole word, prefixes of some bytes."""
    out = [(spans.hashes(LOWER), np.arange(len(spans)))]
    lens = spans.ends - spans.starts
    for k in PREFIXES:
        fits = np.flatnonzero(lens > k)
        h = np.full(len(fits), U(k))
        for i in range(k):
            h = h * _M + LOWER[spans.data[spans.starts[fits] + i]].astype(np.uint64)
        out.append((mix(h), fits))
    return out


@dataclass
class Classifier:
    keys: np.ndarray  # sorted
    weights: np.ndarray  # keys x LEVELS
    bias: float
    length: float

    def hits(self, spans: Spans):
        """(text, key, level) of the keys a text has, at each level it reaches."""
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.keys):
            seen = np.zeros(1 << 18, bool)
            seen[(self.keys >> U(46)).astype(np.int64)] = True
            for key, word in keys_of(spans):
                may = np.flatnonzero(seen[(key >> U(46)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
                same = self.keys[at] == key[may]
                docs.append(spans.doc[word[may[same]]])
                keys.append(at[same])
        pair, n = np.unique(np.concatenate(docs) * max(1, len(self.keys)) + np.concatenate(keys), return_counts=True)
        n = np.minimum(n, LEVELS)
        pair = np.repeat(pair, n)
        level = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        return pair // max(1, len(self.keys)), pair % max(1, len(self.keys)), level

    def margin(self, spans: Spans) -> np.ndarray:
        doc, key, level = self.hits(spans)
        n = len(spans.counts)
        return np.bincount(doc, self.weights[key, level], n) + self.bias + self.length * np.log1p(spans.counts)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _shares(spans: Spans) -> list[dict]:
    """By level: (keys, share of the texts that have them so often), and their number of texts."""
    doc, key = (np.concatenate(x) for x in zip(*[(spans.doc[w].astype(np.uint64), k) for k, w in keys_of(spans)], strict=True))
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, int)
    times = np.diff(np.append(start, len(key)))
    out = []
    for level in range(LEVELS):
        k, n = np.unique(key[start][times > level], return_counts=True)
        out.append((k, n / max(1, len(spans.counts))))
    return out


def candidates(positive: list[str], least: int = 3) -> np.ndarray:
    """The keys that `least` positive texts have, sorted: as many as the bounded positives give."""
    keys, share = _shares(Spans(*of_texts(positive), LETTERS))[0]
    return keys[share * len(positive) >= least - 0.5]


class _Shares:
    """How many texts have each of some keys once, twice and thrice."""

    def __init__(self, keys: np.ndarray):
        self.finder = Classifier(keys, np.zeros((len(keys), LEVELS)), 0.0, 0.0)
        self.counts = np.zeros((len(keys), LEVELS), np.int64)

    def take(self, data, offsets, nulls):
        _, key, level = self.finder.hits(Spans(data, offsets, LETTERS))
        self.counts += np.bincount(key * LEVELS + level, minlength=self.counts.size).reshape(self.counts.shape)

    def finish(self):
        key, level = np.nonzero(self.counts)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(self.counts[key, level])], names=["key", "level", "n"])


def shares(texts: DataFrame, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level (keys, share of all rows of texts (text) that have them so often); tasks sum their own first."""
    n = max(1, texts.count())
    handle = texts.sparkSession.sparkContext.broadcast(keys)
    counted = kernel_rows(texts, "text", "key int, level int, n long", lambda: _Shares(handle.value)).groupBy("key", "level").agg(F.sum("n").alias("n")).toArrow()
    handle.destroy()
    key, level, times = (counted[c].to_numpy() for c in ("key", "level", "n"))
    out = []
    for g in range(LEVELS):
        own = np.sort(key[level == g])
        out.append((keys[own], times[level == g][np.argsort(key[level == g])] / n))
    return out


def train(positive: list[str], unlabelled: list[str], prior: float, n_features: int = 3000, epochs: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 5, base_shares: list | None = None, smooth: int = 4000) -> Classifier:
    """Selects features by how far their share among positives exceeds the unlabelled's (base_shares, where they were counted over
    more texts than these; `smooth` such texts' worth of doubt stays, whatever their number), then descends the nnPU risk."""
    if not positive or not unlabelled:
        return Classifier(np.zeros(0, np.uint64), np.zeros((0, LEVELS)), -4.0, 0.0)
    groups = [Spans(*of_texts(x), LETTERS) for x in (positive, unlabelled)]
    n_p, n_u = len(positive), len(unlabelled) if base_shares is None else smooth
    held = [_shares(groups[0]), _shares(groups[1]) if base_shares is None else base_shares]
    found: dict[int, float] = {}
    for (kp, sp), (ku, su) in zip(*held, strict=True):
        at = np.minimum(np.searchsorted(ku, kp), max(0, len(ku) - 1))
        base = np.where(ku[at] == kp, su[at], 0.0) if len(ku) else np.zeros(len(kp))
        base = np.maximum(base - prior * sp, 0) / (1 - prior)  # the unlabelled hold positives, too
        z = (sp - base) / np.sqrt((base + 1.0 / n_u) * (1.0 / n_p + 1.0 / n_u))
        for k in np.flatnonzero((z > 4) & (sp * n_p >= 3) & (sp > 3 * base)):
            found[int(kp[k])] = max(found.get(int(kp[k]), 0.0), float(z[k]))
    best = sorted(found, key=lambda k: (-found[k], k))[:n_features]
    model = Classifier(np.sort(np.array(best, np.uint64)), np.zeros((len(best), LEVELS)), -2.0, 0.0)
    x = [(*model.hits(s), np.log1p(s.counts)) for s in groups]
    params = [model.weights.ravel(), np.array([model.bias, model.length])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        p, u = (np.bincount(d, params[0][k * LEVELS + g], len(c)) + params[1][0] + params[1][1] * c for d, k, g, c in x)

        def pull(group, slope):  # the gradient of the mean of a loss with this slope
            d, k, g, c = x[group]
            slope = slope / len(c)
            return [np.bincount(k * LEVELS + g, slope[d], len(params[0])), np.array([slope.sum(), (slope * c).sum()])]

        plus, minus, other = pull(0, sigmoid(p) - 1), pull(0, sigmoid(p)), pull(1, sigmoid(u))
        rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        if rest >= 0:
            grads = [prior * a + c - prior * b for a, b, c in zip(plus, minus, other, strict=True)]
        else:
            grads = [prior * b - c for b, c in zip(minus, other, strict=True)]
        grads[0] = grads[0] + decay * params[0]
        for k in range(2):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Classifier(model.keys, params[0].reshape(-1, LEVELS), float(params[1][0]), float(params[1][1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, held: int = 2, max_positive: int = 1500, max_unlabelled: int = 4000, max_chars: int = 20_000, grow: int = 1 << 16, **options) -> Classifier:
    """A classifier of samples of the learning folds: at most max_positive toxic texts, and max_unlabelled of all texts, which
    beyond `grow` rows grow with their fourth root. Which features stand out is told by the shares among all texts.

    The prior is the share of toxic ones among the learning folds' labelled ids; an id with several labels is toxic if one of
    them says so. Of a longer text a passage of max_chars characters is taken.
    """
    learn = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(fold(F.col("doc_id"), modulus) != held)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("mark")).where((fold(F.col("doc_id"), modulus) != held) & F.col("mark").isNotNull()).groupBy("doc_id").agg(F.max("mark").alias("mark"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    marked = marks.where("mark = 1").select("doc_id")
    pos = sample_rows(learn, ["doc_id"], F.lit(0), max_positive, max_chars, ["text"], ids_of=marked)
    many = int(max_unlabelled * max(1.0, (learn.count() / grow) ** 0.25))
    unl = sample_rows(learn, ["doc_id"], F.lit(0), many, max_chars, ["text"], salt=11)
    pos, unl = [r["text"] for r in pos], [r["text"] for r in unl]
    base = shares(learn.select("text"), candidates(pos)) if pos and unl else None
    return train(pos, unl, min(max(toxic / n if n else 0.01, 1e-4), 0.9), base_shares=base, smooth=max_unlabelled, **options)


def score(docs: DataFrame, labels: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, modulus: int = 4, held: int = 2, **options) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text with no words. With no labels or no texts to learn from, all score low.
    A text of any length is scored whole; repeated rows are scored alike; a score at the threshold is predicted 1; a null id is
    in fold 0; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit(docs, labels, id_col, text_col, modulus=modulus, held=held, **options)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = handle.value
        return lambda data, offsets, nulls: [sigmoid(model.margin(Spans(data, offsets, LETTERS)))]

    out = kernel_columns(docs, "text", [T.StructField(fresh("score", ["doc_id"]), T.DoubleType())], make, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
