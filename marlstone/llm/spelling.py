"""Spelling variants: words of a corpus that differ by one code point, grouped under their commonest form.

Each word of the vocabulary emits its full neighbourhood over the letters that the vocabulary has: every distinct deletion,
replacement and insertion. A candidate that is a word is a near word, so a hash join is all that is needed, and no
distance is ever computed. Candidates are first 64-bit polynomial hashes, each made of its word's prefix sums in a few
operations whatever the word's length, and looked up in the sorted hashes of the vocabulary; only those found there become
strings, which Spark joins to the words. The hashes go out in shards of a bounded size. Tasks count their own words first.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, release, remove, written
from .textbytes import LOWER, U, byte_set, mix, powers, row_slices, utf8_column

_G = U(0x9E3779B97F4A7C15)
_ASCII = byte_set((0x41, 0x5A), (0x61, 0x7A))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, code points) of the maximal runs of A to Z, a to z and U+00C0 to U+00FF, which are 0xC3 and any byte."""
    n = len(data)
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, ends - starts - (leads[ends] - leads[starts])


class Words:
    """Counts of a task's words, slips made, flushed whenever there are `most`."""

    def __init__(self, shortest: int, every: int = 97, most: int = 300_000):
        self.shortest, self.every, self.most, self.counts = shortest, every, most, Counter()

    def take(self, ids: list, data: np.ndarray, offsets: np.ndarray):
        """ids are texts' keys as strings, None as the empty one. Of the runs that a key's hash picks, one in `every`, each loses
        the code point that the hash points to."""
        starts, ends, text, size = runs(data, offsets)
        kept = np.flatnonzero(size >= self.shortest)
        raw = LOWER[data].tobytes()
        found = [raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]
        heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
        h = np.fromiter(map(zlib.crc32, found, map(heads.__getitem__, text[kept].tolist())), np.int64, len(found))
        for k in np.flatnonzero(h % self.every == 0).tolist():
            word, at = found[k].decode(), int(h[k] % size[kept[k]])
            found[k] = (word[:at] + word[at + 1 :]).encode() if len(word) > self.shortest else None
        self.counts.update(found)
        del self.counts[None]
        if len(self.counts) > self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        words, n = list(self.counts), list(self.counts.values())
        self.counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, max_bytes: int = 1 << 20) -> DataFrame:
    """word, n: of the runs of all texts, slips made, those of `shortest` code points or more that occur `least` times or more."""

    def count(batches):
        words = Words(shortest)
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in row_slices(offsets, max_bytes):
                yield from words.take(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            release()
        yield words.flush()

    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Flat:
    """Words as code points, and what hashes of their neighbours are made of. A word's hash is the sum of value(c_i) * p^i."""

    def __init__(self, words: list[str]):
        self.words = words
        self.points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(self.lens)))
        self.power = powers(int(self.lens.max(initial=0)) + 2)
        self.inverse = U(pow(int(self.power[1]), -1, 1 << 64))
        at = np.arange(len(self.points)) - np.repeat(self.first[:-1], self.lens)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value(self.points) * self.power[at], dtype=np.uint64)))
        self.hashes = total[self.first[1:]] - total[self.first[:-1]]
        self.before = total

    def found(self, letters: np.ndarray, known: Known, step: int = 1 << 12):
        """(word, candidate) places and strings of all distinct neighbours that `known` holds; places are cut into steps."""
        places = self.lens + 1  # one for each code point and one for the end
        ends = np.cumsum(places)
        for k in range(0, int(ends[-1]) if len(ends) else 0, step):
            g = np.arange(k, min(k + step, int(ends[-1])))
            w = np.searchsorted(ends, g, "right")
            i = g - (ends[w] - places[w])
            at = self.first[w] + i
            inside = i < self.lens[w]
            here = self.points[np.minimum(at, len(self.points) - 1)] * inside  # 0, no letter, at the end
            left = self.before[at] - self.before[self.first[w]]
            right = self.hashes[w] - left
            own = value(here) * self.power[i] * inside.astype(np.uint64)
            following = self.points[np.minimum(at + 1, len(self.points) - 1)]
            # of equal code points in a row the last is deleted, and an equal one goes in after the last
            gone = inside & ((i + 1 == self.lens[w]) | (following != here))
            hit = np.flatnonzero(gone)
            hit = hit[known.holds(left[hit] + (right[hit] - own[hit]) * self.inverse)]
            for x, p in zip(w[hit].tolist(), i[hit].tolist(), strict=True):
                yield x, self.words[x][:p] + self.words[x][p + 1 :]
            added = value(letters)[None, :] * self.power[i][:, None]
            other = here[:, None] != letters[None, :]
            for insert, h in ((False, (left + right - own)[:, None] + added), (True, (left + right * self.power[1])[:, None] + added)):
                r, c = np.nonzero(other if insert else other & inside[:, None])
                hit = np.flatnonzero(known.holds(h[r, c]))
                for x, p, letter in zip(w[r[hit]].tolist(), i[r[hit]].tolist(), letters[c[hit]].tolist(), strict=True):
                    yield x, self.words[x][:p] + chr(letter) + self.words[x][p if insert else p + 1 :]


def value(points: np.ndarray) -> np.ndarray:
    return mix((points.astype(np.uint64) + U(1)) * _G)


class Known:
    """A set of 64-bit hashes: a bitmap of sixteen bits and more a hash, and the sorted hashes behind it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        size = max(10, int(16 * max(1, len(hashes)) - 1).bit_length())
        self.shift = U(64 - size)
        self.bits = np.zeros(1 << (size - 3), np.uint8)
        at = mix(self.sorted) >> self.shift
        np.bitwise_or.at(self.bits, (at >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U(7)).astype(np.uint8)))

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = mix(h) >> self.shift
        out = (self.bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        some = np.flatnonzero(out)
        place = np.searchsorted(self.sorted, h[some])
        out[some] = self.sorted[np.minimum(place, len(self.sorted) - 1)] == h[some] if len(self.sorted) else False
        return out


def near(vocab: DataFrame, shard: int = 1 << 22) -> DataFrame:
    """word, n, near: each word with every word of vocab (word, n) that one inserted, deleted or replaced code point makes of
    it; a written table. vocab is read several times."""
    spark = vocab.sparkSession
    bounded_batches(spark)
    n, points = vocab.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    letters = np.array(sorted(ord(r[0]) for r in vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint32)  # at most the pattern's class
    spread = vocab.repartition(max(1, -(-points // (1 << 17))), "word")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Flat(batch.column(0).to_pylist()).hashes.view(np.int64))], names=["h"])

    shards = -(-n // shard)
    hashes = written(vocab.select("word").mapInArrow(hashed, "h long"), "hashes")
    tables = []
    for k in range(max(1, shards)):
        part = hashes if shards <= 1 else hashes.where(F.pmod("h", F.lit(shards)) == k)
        sent = spark.sparkContext.broadcast(part.toArrow()["h"].to_numpy().view(np.uint64).copy())

        def emit(batches, sent=sent):
            known = None
            for batch in batches:
                known = Known(sent.value) if known is None else known
                for j in range(0, batch.num_rows, 4096):
                    words, counts = batch.column(0).slice(j, 4096).to_pylist(), batch.column(1).slice(j, 4096)
                    pairs = list(Flat(words).found(letters, known))
                    at = pa.array([p[0] for p in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(j, 4096).take(at), counts.take(at), pa.array([p[1] for p in pairs], pa.string())], names=["word", "n", "near"])
                release()

        tables.append(written(spread.select("word", "n").mapInArrow(emit, "word string, n long, near string"), "near"))
        sent.destroy()
    remove(hashes)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    out._marlstone_tables = tables
    return out


def forms(vocab: DataFrame, shard: int = 1 << 22) -> DataFrame:
    """word, n, form, form_n, n_near of vocab (word, n): the form is the near word of the largest count, of equal ones the first in
    code-point order, if it occurs twice as often as the word at least; else null."""
    candidates = near(vocab, shard)
    found = candidates.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    out = vocab.join(best, "word", "left")
    strong = -F.col("b.m") >= 2 * F.col("n")
    out = written(out.select("word", "n", F.when(strong, F.col("b.near")).alias("form"), F.when(strong, -F.col("b.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near")), "forms")
    remove(*candidates._marlstone_tables)
    return out


def roots(formed: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, twice as far each step. A form occurs twice as often, so none comes back."""
    at = written(formed.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        remove(at)
        at = moved
        if moved.where("moved").isEmpty():
            return at.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, shard: int = 1 << 22) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words, a null id slips like the empty one, and each of repeated rows counts. Words of
    any length take part, long ones in steps of bounded memory. Words of equal count tie: neither is the other's form, and of
    equally common forms the first in code-point order is taken. Other columns are ignored; an empty table gives no rows.
    """
    vocab = written(vocabulary(docs, id_col, text_col, shortest, least), "vocabulary")
    formed = forms(vocab, shard)
    remove(vocab)
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
