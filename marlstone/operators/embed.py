"""Embedding: a protocol, and a default that needs no model."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row a text; a blank text is a zero vector."""
        ...


def _fnv(gram: str) -> int:
    """FNV-1a of 64 bits."""
    h = 1469598103934665603
    for b in gram.encode("utf-8", "ignore"):
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


_trigram = lru_cache(1 << 16)(_fnv)  # words share these

#: Words that are met at once.
STEP = 1 << 12


def _gram_hashes(word: str) -> tuple[int, ...]:
    """Hashes of the word and its letter trigrams, ends included."""
    padded = f" {word} "
    grams = {padded[i : i + 3] for i in range(len(padded) - 2)} - {word}
    return (_fnv(word), *map(_trigram, grams))


class HashEmbedder:
    """Signed feature hashing of words and of their letter trigrams, to unit length. It has no notion of meaning."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim
        self._at, self._rows = {}, np.zeros((0, dim), np.float32)  # words met, and the sums of their signs

    def __getstate__(self):
        return self.__dict__ | {"_at": {}, "_rows": np.zeros((0, self.dim), np.float32)}

    def _meet(self, words: list[str]) -> None:
        """Keeps the sums of signs by place of the words that are new, all made at once; once there is no room, of these alone."""
        room = max(1 << 13, (1 << 23) // self.dim)
        if len(self._at) + len(words) > room or not len(self._rows):
            self._at, self._rows = {}, np.zeros((room, self.dim), np.float32)
        if new := [w for w in set(words) if w not in self._at]:
            grams = [_gram_hashes(w) for w in new]
            h = np.fromiter(chain.from_iterable(grams), np.uint64)
            at = np.repeat(np.arange(len(new)), [len(g) for g in grams]) * self.dim + (h % np.uint64(self.dim)).astype(np.int64)
            first = len(self._at)
            self._rows[first : first + len(new)] = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(new) * self.dim).reshape(len(new), self.dim)
            self._at.update(zip(new, range(first, first + len(new)), strict=True))

    def _add(self, out: np.ndarray, words: list[str], counts: list[int]) -> None:
        """Adds the rows of each text's words to its row of out: whole numbers, so in any order."""
        of = np.repeat(np.arange(len(counts)), counts)
        for i in range(0, len(words), STEP):
            part, own = words[i : i + STEP], of[i : i + STEP]
            self._meet(part)
            start = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[start]] += np.add.reduceat(self._rows[[self._at[w] for w in part]], start)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        words, counts, first = [], [], 0
        for k, text in enumerate(texts, 1):
            own = re.findall(r"\w+", (text or "").lower())
            words += own
            counts.append(len(own))
            if len(words) >= STEP or k == len(texts):
                self._add(out[first:k], words, counts)
                words, counts, first = [], [], k
        for row in out:
            size = float(np.sqrt((row * row).sum()))
            if size:
                row /= size
        return out


#: Vector lengths of common models; others have 768 until they are loaded.
DIMENSIONS = {"BAAI/bge-m3": 1024, "jhgan/ko-sroberta-multitask": 768, "intfloat/multilingual-e5-large": 1024, "intfloat/multilingual-e5-base": 768}


class ModelEmbedder:
    """A sentence model, loaded where it is first used; `load` gives an object with encode(texts, batch_size=).

    A batch too large for the device's buffers is done again text by text; any other failure is raised.
    """

    def __init__(self, name: str, batch_size: int = 32, dim: int | None = None, load: Callable[[str], object] | None = None):
        self.name, self.batch_size, self.dim, self.load = name, batch_size, dim or DIMENSIONS.get(name, 768), load or _sentence_model
        self._model = None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    @property
    def loaded(self) -> bool:
        return self._model is not None

    def unload(self) -> None:
        self._model = None

    def info(self) -> dict:
        return {"model": self.name, "dimension": self.dim, "device": str(getattr(self._model, "device", "cpu"))}

    def embed_text(self, text: str) -> np.ndarray:
        if not isinstance(text, str) or not text:
            raise ValueError("there is no text")
        return self.embed([text])[0]

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            self._model = self.load(self.name)
        filled = [i for i, t in enumerate(texts) if t and t.strip()]
        rows = []
        for i in range(0, len(filled), self.batch_size):
            part = [texts[k] for k in filled[i : i + self.batch_size]]
            try:
                rows.extend(self._model.encode(part, batch_size=self.batch_size))
            except Exception as e:
                if "buffer size" not in str(e).lower():
                    raise
                rows.extend(self._model.encode([t], batch_size=1)[0] for t in part)
        if rows:
            self.dim = len(rows[0])
        out = np.zeros((len(texts), self.dim), np.float32)
        if rows:
            out[filled] = np.stack(rows)
        return out


def _sentence_model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def by_name(name: str, batch_size: int = 32) -> Embedder:
    """The hash embedder for `hash-<dim>`, a sentence model for any other name."""
    if name.startswith("hash-"):
        return HashEmbedder(int(name.removeprefix("hash-")))
    return ModelEmbedder(name, batch_size)


def embedded(text: Column, embedder: Embedder, batch: int = 64) -> Column:
    """Vectors of texts, in Arrow batches; the embedder comes with the function, so it may load its model there."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else "" for t in texts]
        rows = [embedder.embed(values[i : i + batch]) for i in range(0, len(values), batch)]
        return pd.Series([v for part in rows for v in np.asarray(part, np.float32)], index=texts.index)

    return run(text)
