"""Chunking: paragraphs, sentences, greedy packing, forced cuts, overlap. Sizes are in characters.

Packing is sequential within a text, so it is one vectorised function from text to an array, exploded afterwards; the
same function serves SQL as a table function (`register`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import chunk_id, strip

#: What ends a sentence, Korean endings first.
ENDINGS = (r"다\.", r"요\.", r"까\?", r"나\?", r"세요\.", r"습니다\.", r"입니다\.", r"합니다\.", r"[.!?]")
_END = re.compile("|".join(ENDINGS))


def paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, text.split("\n\n")) if p]


def sentences(paragraph: str) -> list[str]:
    """Sentences with their endings; white space around them and before an ending goes."""
    found, at = [], 0
    for m in _END.finditer(paragraph):
        found.append(paragraph[at : m.start()].strip() + m[0].strip())
        at = m.end()
    found.append(paragraph[at:].strip())
    return [s for s in found if s] or [paragraph.strip()]


def forced(text: str, size: int) -> Iterator[str]:
    """Pieces of an overlong sentence, cut at the last space within size, or hard where there is none."""
    while len(text) > size:
        space = text.rfind(" ", 0, size)
        cut = space if space > 0 else size
        yield text[:cut].strip()
        text = text[cut:].strip()
    if text:
        yield text


def packed(units: Iterable[str], size: int) -> Iterator[str]:
    """Units joined, without a separator, while they fit; the pieces of an overlong one stand alone."""
    open_ = ""
    for unit in units:
        if len(unit) <= size and len(open_) + len(unit) <= size:
            open_ += unit
            continue
        if open_:
            yield open_
        open_ = ""
        if len(unit) > size:
            yield from forced(unit, size)
        else:
            open_ = unit
    if open_:
        yield open_


def pack(units: list[str], size: int) -> list[str]:
    return list(packed(units, size))


def joined(chunks: Iterable[str], overlap: int) -> Iterator[str]:
    """Each chunk after the first with the end of its predecessor (as packed) in front."""
    before = ""
    for chunk in chunks:
        yield before[-overlap:] + chunk if overlap > 0 else chunk
        before = chunk


def overlapped(chunks: list[str], overlap: int) -> list[str]:
    return list(joined(chunks, overlap))


def split(text: str | None, size: int = 800, overlap: int = 100) -> list[str]:
    units: list[str] = []
    for p in paragraphs(text or ""):
        units.extend(sentences(p) if len(p) > size else [p])
    return overlapped(pack(units, size), overlap)


def _units(pieces: Iterable[str], size: int) -> Iterator[str]:
    """The units of split() for a text that comes in pieces; no more is held than a piece, and a sentence or a short paragraph."""
    open_, long = "", False  # what is left of a paragraph, and whether sentences of it have gone
    for piece, last in ((p, last) for last, some in ((False, pieces), (True, ("",))) for p in some):
        open_, start = open_ + piece, 0
        while True:
            end = open_.find("\n\n", start)
            whole = end >= 0 or last
            p = open_[start:end] if end >= 0 else open_[start:]
            if long or len(p.strip()) > size:
                at = 0
                for m in _END.finditer(p):
                    if not whole and m.start() + 4 > len(p):  # an ending has four characters at most, so what comes may change it
                        break
                    if unit := p[at : m.start()].strip() + m[0].strip():
                        yield unit
                    at, long = m.end(), True
                p = p[at:]
                if whole and (rest := p.strip()):
                    yield rest
            elif whole and (rest := p.strip()):
                yield rest
            if end < 0:
                open_ = "" if last else p
                break
            start, long = end + 2, False


def stream(pieces: Iterable[str], size: int = 800, overlap: int = 100) -> Iterator[str]:
    """split() of a text that comes in pieces, a chunk at a time."""
    return joined(packed(_units(pieces, size), size), overlap)


def chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """The chunks of a text as an array; none for a null or blank one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, size, overlap))

    return run(text)


def paragraph_array(text: Column) -> Column:
    """The paragraphs of a text: pieces between empty lines, stripped, that are not blank."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def not_blank(text: Column) -> Column:
    """Whether a chunk is worth a vector."""
    return strip(text) != ""


def sentence_array(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else sentences(t))

    return run(text)


def exploded(docs: DataFrame, path: Column, text: Column, size: int = 800, overlap: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk: the kept columns, file_path, chunk_id, chunk_index, total_chunks, text."""
    made = docs.select(*keep, path.alias("file_path"), chunks(text, size, overlap).alias("_chunks"))
    rows = made.select(*keep, "file_path", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    return rows.select(*keep, "file_path", chunk_id(F.col("file_path"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "total_chunks", "text")


class _ChunkTable:
    def eval(self, text: str, size: int, overlap: int):
        for k, c in enumerate(split(text, size, overlap)):
            yield k, c


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    """SQL: SELECT ... FROM docs, LATERAL chunk_text(text, 800, 100)."""
    spark.udtf.register(name, F.udtf(_ChunkTable, returnType="chunk_index int, chunk string"))
