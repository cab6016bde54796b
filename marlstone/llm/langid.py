"""Language identification: a linear-chain conditional random field labels the words of possibly code-switched text.

Features of a word, hashed into one table: its letters' n-grams of 2 to 4 bytes (with the word's ends), prefixes and
suffixes of 3 and 5 bytes, and the word itself (lexicon). Transitions are learned. Forward-backward gives each word's
label probabilities; a text's language is the label with the largest sum of them, its score that label's share. The
labels' probabilities sum to 1 in any text, so a second test finds texts of no learned language: the mean log frequency
of its letter trigrams, each in training text of its word's label, is far below that of training text not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fold, fresh, kernel_columns, sample_rows
from .textbytes import LETTERS, LOWER, Spans, U, of_texts, sums_by

UNKNOWN = "und"
#: Of the test for texts of no learned language: what a letter may lack, over the root of the letters; deviations, and the least margin.
SLACK, DEVIATIONS, MARGIN = 6.0, 6.0, 0.5
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _slot(h: np.ndarray, shift) -> np.ndarray:
    """The table's row of a hash."""
    h = h ^ (h >> U(31))
    h *= U(0xD6E8FEB86659FD93)
    h >>= shift
    return h.view(np.int64)


def features(spans: Spans, bits: int):
    """(indices, word of each index) in word order within each of some kinds: n-grams at positions, then one a word."""
    data = spans.data
    shift = U(64 - bits)
    lens = spans.ends - spans.starts
    word = np.repeat(np.arange(len(spans)), lens)
    at = np.concatenate(([0], np.cumsum(lens)))
    pos = np.arange(len(word)) - at[word] + spans.starts[word]
    last = spans.ends[word] - 1
    byte = LOWER[data].astype(np.uint64) + U(1)
    padded = np.concatenate((byte, np.zeros(6, np.uint64)))
    b0 = byte[pos]
    before = np.where(pos > spans.starts[word], padded[pos - 1], U(0))
    after = np.where(pos < last, padded[pos + 1], U(0))
    second = padded[pos + 2]
    g2 = before * _A + b0 * _B + U(2)
    g3 = g2 + after * _C + U(3)
    kinds = [(_slot(g2, shift), word), (_slot(g3, shift), word)]
    room = pos + 2 <= last
    kinds.append((_slot(g3[room] * _A + second[room] * _B + U(4), shift), word[room]))
    for k in (3, 5):
        fits = np.flatnonzero(lens >= k)
        for begin, tag in ((spans.starts[fits], 10), (spans.ends[fits] - k, 20)):
            h = np.full(len(fits), U(tag + k))
            for i in range(k):
                h = h * _A + padded[begin + i]
            kinds.append((_slot(h, shift), fits))
    kinds.append((_slot(spans.hashes(LOWER) ^ _C, shift), np.arange(len(spans))))
    return kinds


@dataclass
class Crf:
    labels: list
    weights: np.ndarray  # features x labels
    trans: np.ndarray
    start: np.ndarray
    bits: int
    typical: np.ndarray | None = None  # features x labels: a trigram's log frequency, less the least mean of a text of the language

    def foreign(self, spans: Spans, kinds: list, post: np.ndarray) -> np.ndarray:
        """Which texts are of no learned language. A mean over few letters scatters more, so the limit gives way to short texts."""
        if self.typical is None or not len(spans):
            return np.zeros(len(spans.counts), bool)
        index, word = kinds[1]
        lens = spans.ends - spans.starts
        sums = np.add.reduceat(self.typical[index, post.argmax(1)[word]].astype(np.float64), np.concatenate(([0], np.cumsum(lens)))[:-1])
        return sums_by(spans.first, sums) < -SLACK * np.sqrt(sums_by(spans.first, lens))

    def emissions(self, spans: Spans, kinds: list | None = None) -> np.ndarray:
        out = np.zeros((len(spans), len(self.labels)), np.float32)
        if len(spans):
            lens = spans.ends - spans.starts
            at = np.concatenate(([0], np.cumsum(lens)))[:-1]
            kinds = features(spans, self.bits) if kinds is None else kinds
            dense = self.weights[kinds[0][0]] + self.weights[kinds[1][0]]
            room = np.flatnonzero(np.arange(len(dense)) - np.repeat(at, lens) + 2 <= np.repeat(lens, lens) - 1)
            dense[room] += self.weights[kinds[2][0]]
            out += np.add.reduceat(dense, at, axis=0)
            for index, word in kinds[3:]:
                out[word] += self.weights[index]  # at most one of a kind a word
        return out

    def marginals(self, spans: Spans, emit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward-backward over each text's whole chain: each word's label probabilities, its forward message, and what
        it sends back (its emission times its backward message), each up to a factor."""
        emit = self.emissions(spans) if emit is None else emit
        n = len(self.labels)
        order = np.argsort(-spans.counts, kind="stable")
        alive = np.searchsorted(-spans.counts[order], -np.arange(1, (spans.counts.max() if len(spans.counts) else 0) + 1), "right")
        # words by place in their text, the longest texts first: a step of all texts is one slice
        begin = np.concatenate(([0], np.cumsum(alive)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = spans.doc
        at = begin[np.arange(len(doc)) - spans.first[:-1][doc]] + rank[doc]
        e = np.empty((len(doc), n), np.float32)
        e[at] = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
        step, prior, ones = np.exp(self.trans).astype(np.float32), np.exp(self.start).astype(np.float32), np.ones((n, n), np.float32)
        alpha, beta, sent = np.empty_like(e), np.empty_like(e), np.empty_like(e)
        bounds = begin.tolist()
        prev = None
        for i, j in zip(bounds, bounds[1:], strict=False):
            now = alpha[i:j]
            if prev is None:
                now[:] = prior
            else:
                np.matmul(prev[: j - i], step, out=now)
            now *= e[i:j]
            now /= now @ ones  # every column of the product is the row's sum
            prev = now
        back, message = step.T.copy(), np.ones((len(order), n), np.float32)
        for i, j in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
            now, own = sent[i:j], message[: j - i]
            beta[i:j] = own
            np.multiply(e[i:j], own, out=now)
            np.matmul(now, back, out=own)
            own /= own @ ones
        out = alpha * beta
        out /= out.sum(axis=1, keepdims=True)
        return out[at], alpha[at], sent[at]


def train(texts: list[str], langs: list[str], bits: int = 18, epochs: int = 12, rate: float = 0.25, words: int = 150, switch: float = 0.3, decay: float = 2e-5, seed: int = 3) -> Crf:
    """Fits the chain on `words`-word passages; a share `switch` of the passages are two texts' halves joined, labelled by word."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    pieces, tags = [], []
    for text, lang in zip(texts, langs, strict=True):
        parts = text.split()
        at = int(rng.integers(0, max(1, len(parts) - words + 1)))
        pieces.append(parts[at : at + words])
        tags.append(number[lang])
    joined, gold_by = [], []
    for k, (piece, tag) in enumerate(zip(pieces, tags, strict=True)):
        if rng.random() < switch and len(pieces) > 1:
            o = int(rng.integers(0, len(pieces)))
            half = len(piece) // 2
            joined.append(" ".join(piece[:half]) + "\n" + " ".join(pieces[o][len(pieces[o]) // 2 :]))
            gold_by.append((tag, tags[o]))
        else:
            joined.append(" ".join(piece) + "\n")
            gold_by.append((tag, tag))
    n_labels = max(1, len(labels))
    typical = typicality(pieces, tags, n_labels, bits) if labels else None
    crf = Crf(labels, np.zeros((1 << bits, n_labels), np.float32), np.full((n_labels, n_labels), -1.0) + 2 * np.eye(n_labels), np.zeros(n_labels), bits, typical)
    if len(labels) < 2:
        return crf
    g_w, g_t, g_s = np.full_like(crf.weights, 1e-3), np.full_like(crf.trans, 1e-1), np.full_like(crf.start, 1e-1)
    for _ in range(epochs):
        order = rng.permutation(len(joined))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            data, offsets = of_texts([joined[k] for k in batch])
            spans = Spans(data, offsets, LETTERS)
            if not len(spans):
                continue
            newline = np.array([joined[k].encode().index(b"\n") for k in batch]) + offsets[:-1]
            pair = np.array([gold_by[k] for k in batch])
            doc = spans.doc
            gold = np.where(spans.starts < newline[doc], pair[doc, 0], pair[doc, 1])
            emit = crf.emissions(spans)
            post, alpha, sent = crf.marginals(spans, emit)
            delta = post.copy()
            delta[np.arange(len(gold)), gold] -= 1
            kinds = features(spans, bits)
            index = np.concatenate([k[0] for k in kinds])
            word = np.concatenate([k[1] for k in kinds])
            rows, inv = np.unique(index, return_inverse=True)
            g = np.column_stack([np.bincount(inv, delta[word, c]) for c in range(n_labels)]) / len(batch)
            g += decay * crf.weights[rows]
            g_w[rows] += g * g
            crf.weights[rows] -= rate * g / np.sqrt(g_w[rows])
            # transitions: expected pairs of neighbours' labels, less the given ones
            heads = np.flatnonzero(np.diff(doc, append=-1) == 0)
            step = np.exp(crf.trans)
            both = ((alpha[heads] @ step) * sent[heads + 1]).sum(axis=1, keepdims=True)
            gt = step * ((alpha[heads] / both).T @ sent[heads + 1])  # no array of labels x labels a word
            np.add.at(gt, (gold[heads], gold[heads + 1]), -1)
            gt /= len(batch)
            g_t += gt * gt
            crf.trans -= rate * 0.3 * gt / np.sqrt(g_t)
            begins = spans.first[:-1][spans.counts > 0]
            gs = delta[begins].sum(0) / len(batch)
            g_s += gs * gs
            crf.start -= rate * 0.3 * gs / np.sqrt(g_s)
    return crf


def typicality(pieces: list[list[str]], tags: list[int], n_labels: int, bits: int) -> np.ndarray:
    """Crf.typical of passages of words and their labels: frequencies of all; the limit of each half's passages by the
    other half's frequencies. With fewer than 8 passages, each one's words are the halves, and the margin is 2 at least."""
    spans = Spans(*of_texts([" ".join(p) for p in pieces]), LETTERS)
    out = np.zeros((1 << bits, n_labels), np.float32)
    if not len(spans):
        return out
    index, word = features(spans, bits)[1]
    doc, label = spans.doc[word], np.array(tags)[spans.doc[word]]
    logs = lambda x: np.log((np.bincount(x, minlength=1 << bits) + 0.5) / (len(x) + 0.5 * (len(np.unique(x)) + 1)))
    for c in range(n_labels):
        own, d = index[label == c], doc[label == c]
        if not len(own):
            continue
        many = len(np.unique(d)) >= 8
        half = (np.searchsorted(np.unique(d), d) if many else word[label == c]) % 2
        means = []
        for k in (0, 1):
            x, of = logs(own[half == 1 - k]), d[half == k]
            n = np.bincount(of)
            means.append((np.bincount(of, x[own[half == k]]) / np.maximum(n, 1))[n > 0])
        means = np.concatenate(means)
        out[:, c] = logs(own) - means.mean() + max(DEVIATIONS * means.std(), MARGIN if many else 2.0)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, held: int = 0, per_language: int = 192, max_chars: int = 20_000, **options) -> Crf:
    """A model of at most per_language documents of each language, none of the held-out fold, of at most max_chars
    characters of each. Its table has a column a language."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = docs.where((fold(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull())
    rows = sample_rows(learn, ["doc_id"], F.col("lang"), per_language, max_chars, ["text", "lang"])
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def label(docs: DataFrame, model: Crf, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its `keep` columns, all by default) with a struct column, named in `.langid_column`: lang, score, foreign, shares.

    lang is `und` and score 0 if the text is null or empty or has no letters, or if nothing was learned; any other text gets a
    learned language, and foreign says if by its letter trigrams it is of none of them. shares are the labels' shares of the words, in the model's order; of equal shares the first label's, in
    alphabetical order, counts. A text of any length is one chain; repeated rows are labelled alike; columns of any name stay.
    """
    keep = list(docs.columns) if keep is None else keep
    name = fresh("langid", keep)
    own = [fresh(x, keep) for x in ("_lang", "_score", "_shares", "_foreign")]
    kinds = (T.StringType(), T.DoubleType(), T.ArrayType(T.FloatType()), T.BooleanType())
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = handle.value
        names = np.array([*model.labels, UNKNOWN], dtype=object)

        def kernel(data, offsets, nulls):
            spans = Spans(data, offsets, LETTERS)
            n = len(spans.counts)
            if not model.labels or not len(spans):
                return [[UNKNOWN] * n, np.zeros(n), [[]] * n, [False] * n]
            kinds = features(spans, model.bits)
            post = model.marginals(spans, model.emissions(spans, kinds))[0]
            known = spans.counts > 0
            share = np.column_stack([sums_by(spans.first, post[:, c].astype(np.float64)) for c in range(post.shape[1])]) / np.maximum(spans.counts, 1)[:, None]
            best = np.where(known, share.argmax(1), len(model.labels))
            return [list(names[best]), np.where(known, np.clip(share.max(1), 0, 1), 0.0), list(share.astype(np.float32)), known & model.foreign(spans, kinds, post)]

        return kernel

    has = fresh("_letters", [*docs.columns, *own])
    source = docs.withColumn(has, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = kernel_columns(source, text_col, [T.StructField(o, k) for o, k in zip(own, kinds, strict=True)], make, [*keep, has], 1 << 20)
    letters = F.col(has)
    out = out.select(*keep, F.struct(F.when(letters, F.col(own[0])).otherwise(UNKNOWN).alias("lang"), F.when(letters, F.col(own[1])).otherwise(0.0).alias("score"), (letters & F.col(own[3])).alias("foreign"), F.col(own[2]).alias("shares")).alias(name))
    out.langid_column = name
    return out


def predict(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, **options) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, as label() says. Repeated rows are judged alike; a null id is in
    fold 0; texts of any length are judged whole; other columns are ignored; an empty table gives no rows."""
    model = model or fit(docs, id_col, text_col, modulus=modulus, held=held, **options)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = label(docs, model, keep=["doc_id"])
    x = F.col(made.langid_column)
    return made.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"))


def keep_known(docs: DataFrame, min_score: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """docs whose language is learned, by trigrams and at least min_score of their words; the columns stay as they are."""
    made = label(docs, fit(docs, text_col=text_col, **options), text_col)
    x = F.col(made.langid_column)
    return made.where((x["lang"] != UNKNOWN) & ~x["foreign"] & (x["score"] >= min_score)).select(*docs.columns)
