"""Morphemes without an analyser: a lexicon that Spark counts from the corpus, and the best path through a word's lattice.

Where a word may be cut is told by its neighbours. A beginning that many different ends follow is a stem; an end that many different
beginnings precede is an ending or a particle. Both are measured as the entropy of what stands on the other side, over the
distinct words. A word's lattice has an arc for every known stem and ending, and one for any other run as an unknown stem; the
cheapest path of a stem and what follows it tags the pieces, and search keeps the stems alone.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEM, ENDING = "S", "E"

#: Words met in this process, with their stems, and the tables of the lexicon last used here: a Python worker's tasks share them.
_MET: dict[str, tuple[dict[str, list[str]], list]] = {}


def word_counts(docs: DataFrame, text_col: str = "text", longest: int = 24) -> DataFrame:
    """word, n: runs of letters in small letters, none longer than `longest`."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= longest).groupBy("word").agg(F.count("*").alias("n"))


def sides(words: DataFrame, most: int = 4) -> DataFrame:
    """tag, form, types, n, entropy of all beginnings (S) and ends of `most` letters at most (E) of words (word, n).

    types and entropy are those of the other side: the empty end counts as one, and the empty beginning doesn't, as no word is an
    ending alone.
    """
    cut = F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - most), F.length("word"))).alias("k")
    parts = words.select("word", "n", cut).select(F.substring("word", F.lit(1), F.col("k")).alias("left"), F.substring("word", F.col("k") + 1, F.length("word")).alias("right"), "n")
    both = parts.select(F.explode(F.array(F.struct(F.lit(STEM).alias("tag"), F.col("left").alias("form"), "n"), F.struct(F.lit(ENDING).alias("tag"), F.col("right").alias("form"), "n"))).alias("p")).select("p.*").where("form <> ''")
    nlogn = F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    total = F.sum("n")
    return both.groupBy("tag", "form").agg(F.count("*").alias("types"), total.alias("n"), (F.log(total.cast("double")) - nlogn / total).alias("entropy"))


LONGEST = 24  # letters of a word that is cut
_UNIT = 10**9  # costs are added up as whole numbers of billionths, so equal ones tie


class _Forms:
    """Pieces and their costs, looked up for many words at once: by hash, and then letter by letter, so no hash is trusted."""

    def __init__(self, costs: dict[str, int]):
        self.letters, self.tables = 0, {}
        by_length: dict[int, list[str]] = {}
        for form in costs:
            if 0 < len(form) <= LONGEST:
                by_length.setdefault(len(form), []).append(form)
        self.flags = np.zeros(1 << 20, bool)
        for m, forms in by_length.items():
            codes = _codes(forms)
            hashes = _prefixes(codes)[m]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            self.flags[hashes >> np.uint64(44)] = True
            same = int(np.unique(hashes, return_counts=True)[1].max())  # forms of one hash lie side by side
            self.tables[m] = hashes, codes[:, order], np.array([costs[f] for f in forms], np.int64)[order], same
        self.letters = max(by_length, default=0)

    def find(self, codes: np.ndarray, prefixes: np.ndarray, m: int, cost: np.ndarray) -> None:
        """Sets cost (place, word) where the piece of m letters from that place on is known."""
        if m not in self.tables:
            return
        hashes, forms, costs, same = self.tables[m]
        h = (prefixes[m:] - prefixes[:-m] * _POWERS[m]).ravel()
        some = np.flatnonzero(self.flags.take((h >> np.uint64(44)).view(np.int64)))
        h = h.take(some)
        at = np.searchsorted(hashes, h)
        for k in range(same):
            near = np.minimum(at + k, len(hashes) - 1)
            hit = np.flatnonzero(hashes.take(near) == h)
            f = near.take(hit)
            p, w = np.divmod(some.take(hit), codes.shape[1])
            equal = np.ones(len(hit), bool)
            for j in range(m):
                equal &= codes[p + j, w] == forms[j, f]
            cost[p[equal], w[equal]] = costs[f[equal]]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(LONGEST, _BASE))])


def _codes(words: list[str]) -> np.ndarray:
    """(place, word): the code points of words of one length."""
    return np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """(place, word): hashes of the words' beginnings of 0, 1, ... letters."""
    out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
    for k, c in enumerate(codes):
        x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        out[k + 1] = out[k] * _BASE + (x ^ (x >> np.uint64(29)))
    return out


@dataclass
class Lexicon:
    """Costs of stems and endings, in nats. An unknown stem of m letters costs `unknown` and `letter` a letter more."""

    stems: dict[str, float]
    endings: dict[str, float]
    unknown: float = 12.0
    letter: float = 1.5
    join: float = 3.0  # for a second stem in a word
    _known: dict[str, list[str]] = field(default_factory=dict, repr=False)  # words met, with their stems
    _forms: list[_Forms] = field(default_factory=list, repr=False, compare=False)  # of stems and endings
    _stamp: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False, compare=False)

    def arcs(self, word: str, i: int):
        """(end, tag, cost) of all pieces that may begin at i."""
        for j in range(i + 1, len(word) + 1):
            piece = word[i:j]
            known = self.stems.get(piece)
            yield j, STEM, self.unknown + self.letter * (j - i) if known is None else known
            if i and piece in self.endings:
                yield j, ENDING, self.endings[piece]

    def best(self, word: str) -> list[tuple[str, str]]:
        """(piece, tag) of the cheapest path; of equally cheap ones that of fewer pieces, then of the longer first ones."""
        n = len(word)
        rest: list[tuple] = [(0, 0, 0, "")] * (n + 1)  # (cost, pieces, -end of the first, its tag) of what is best from a place on
        for i in range(n - 1, -1, -1):
            steps = []
            for j, tag, own in self.arcs(word, i):
                cost, pieces, *_ = rest[j]
                steps.append((cost + round(own * _UNIT) + (round(self.join * _UNIT) if tag == STEM and i else 0), pieces + 1, -j, tag))
            rest[i] = min(steps)
        out, i = [], 0
        while i < n:
            j, tag = -rest[i][2], rest[i][3]
            out.append((word[i:j], tag))
            i = j
        return out

    def stems_of(self, words: list[str]) -> list[list[str]]:
        """The stems in best() of each of many words, none longer than LONGEST. A length's words go through the lattice together.

        What is best from a place on is one number: the cost, then pieces in 5 bits, then LONGEST less the end of the first in 5, then its tag.
        """
        if not self._forms:
            self._forms += [_Forms({f: round(c * _UNIT) for f, c in costs.items()}) for costs in (self.stems, self.endings)]
        stems, endings = self._forms
        join = round(self.join * _UNIT)
        none = np.iinfo(np.int64).max >> 12
        out: list[list[str]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, all_ks in by_length.items():
            for first in range(0, len(all_ks) if n else 0, 1 << 13):
                ks = all_ks[first : first + (1 << 13)]
                codes = _codes([words[k] for k in ks])
                prefixes = _prefixes(codes)
                own, ends = [], []  # by letters of the piece: costs (place, word) as a stem and as an ending
                for m in range(1, n + 1):
                    own.append(np.full((n - m + 1, len(ks)), round((self.unknown + self.letter * m) * _UNIT), np.int64))
                    stems.find(codes, prefixes, m, own[-1])
                    if m <= endings.letters:
                        ends.append(np.full((n - m + 1, len(ks)), none, np.int64))
                        endings.find(codes, prefixes, m, ends[-1])
                rest = np.zeros((n + 1, len(ks)), np.int64)
                for i in range(n - 1, -1, -1):
                    best = None
                    for m in range(n - i, 0, -1):
                        then = (rest[i + m] & ~63) + (64 + ((LONGEST - i - m) << 1))
                        step = then + ((own[m - 1][i] + (join if i else 0)) << 11) + 1
                        if i and m <= endings.letters:
                            np.minimum(step, then + (ends[m - 1][i] << 11), out=step)
                        best = step if best is None else np.minimum(best, step, out=best)
                    rest[i] = best
                at, column, paths = np.zeros(len(ks), np.int64), np.arange(len(ks)), []
                while (at < n).any():
                    low = rest[at, column] & 63
                    end = np.where(at < n, LONGEST - (low >> 1), n)
                    paths.append((at.tolist(), end.tolist(), ((low & 1 == 1) & (at < n)).tolist()))
                    at = end
                for x, k in enumerate(ks):
                    w = words[k]
                    out[k] = [w[a[x] : e[x]] for a, e, s in paths if s[x]]
        return out

    def split(self, text: str) -> list[str]:
        """The stems of a text's words; words too long for the lattice, and runs that are no letters, stay whole."""
        return self.split_all([text])[0]

    def split_all(self, texts: list[str]) -> list[list[str]]:
        """split() of each text. Words that are not known yet are cut together."""
        import regex

        find = regex.compile(r"\p{L}+|[^\p{L}\s]+").findall
        runs = [[t] if t.isalpha() else find(t) for t in map(str.lower, texts)]
        met = set().union(*runs)
        new = [r for r in met if r not in self._known]
        if len(self._known) + len(new) > 1 << 18:
            self._known.clear()
            new = list(met)
        words = [r for r in new if r[0].isalpha() and len(r) <= LONGEST]
        self._known.update((r, [r]) for r in new)
        self._known.update(zip(words, self.stems_of(words), strict=True))
        return [self._known[r[0]] if len(r) == 1 else list(itertools.chain.from_iterable(map(self._known.__getitem__, r))) for r in runs]

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_forms": []}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self._stamp not in _MET:
            _MET.clear()
        self._known, self._forms = _MET.setdefault(self._stamp, ({}, []))


def learn(docs: DataFrame, text_col: str = "text", entropy: float = 1.5, types: int = 8, least: int = 3, most: int = 100_000) -> Lexicon:
    """The lexicon of a corpus: endings that at least `types` beginnings precede, and stems that occur `least` times, whose other side
    has the entropy; of each the `most` commonest. All words are counted."""
    found = sides(word_counts(docs, text_col)).where((F.col("n") >= least) & (F.col("entropy") >= F.when(F.col("tag") == ENDING, F.lit(entropy)).otherwise(entropy / 3)))
    found = found.where((F.col("tag") == STEM) | (F.col("types") >= types)).select("tag", "form", "n").persist()  # counted once for both
    tables = {}
    for tag in (STEM, ENDING):
        rows = found.where(F.col("tag") == tag).orderBy(F.desc("n"), "form").limit(most).select("form", "n").collect()
        total = sum(r["n"] for r in rows)
        tables[tag] = {r["form"]: -math.log(r["n"] / total) for r in rows}
    found.unpersist()
    return Lexicon(tables[STEM], tables[ENDING])


def splitter(lexicon: Lexicon, hold: int = 1 << 22) -> Callable[[Column], Column]:
    """The lexicon as a tokenizer of the keyword index, for a column of texts; about `hold` bytes are looked at together.

    A word never goes beyond a blank, nor does the way in which small letters are made, so what lies between blanks is split once
    in these bytes, and its other places take the stems from there. As with text.tokenizer, a text that nothing is found in is split
    at white space.
    """

    def split(texts: pa.Array) -> pa.Array:
        pieces = pc.split_pattern(pc.fill_null(texts, ""), " ")
        met = pieces.values.dictionary_encode()
        stems = pa.array(lexicon.split_all(met.dictionary.to_numpy(zero_copy_only=False).tolist()), kind).take(met.indices)
        found = pa.ListArray.from_arrays(stems.offsets.take(pieces.offsets), stems.values, mask=texts.is_null())
        for k in np.flatnonzero(np.diff(found.offsets.to_numpy()) == 0).tolist():
            if rest := (texts[k].as_py() or "").split():
                found = pa.concat_arrays([found[:k], pa.array([rest], kind), found[k + 1 :]])
        return found

    kind = pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // hold
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([split(pa.concat_arrays([texts[a:b]])) for a, b in itertools.pairwise(cuts)] if len(texts) else [pa.array([], kind)])

    return run
