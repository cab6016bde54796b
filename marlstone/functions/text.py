"""Text expressions: white space as the query language knows it, tokens, ids, previews."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode, and the four separators U+001C to U+001F.
SPACE = r"[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Maximal runs that are not white space; case and punctuation stay."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1C-\x1F]+"), F.lit(0))


def tokenizer(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """An expression like `tokens` from a function of one text, a morphological analyser's say.

    A text that it fails on, or finds nothing in, is split at white space.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                return split(text) or text.split()
            except Exception:
                return text.split()

        return texts.map(one)

    return run


def morphemes() -> Callable[[Column], Column]:
    """Korean morphemes without particles and endings of one letter, if the analyser is installed; else `tokens`."""
    try:
        from kiwipiepy import Kiwi
    except ImportError:
        return tokens
    loaded: list = []

    def split(text: str) -> list[str]:
        if not loaded:
            loaded.append(Kiwi())
        found = [(t.form.strip(), t.tag) for t in loaded[0].tokenize(text)]
        return [form for form, tag in found if form and not (len(form) == 1 and tag[:1] in "JE")]

    return tokenizer(split)


@F.pandas_udf(T.StringType())
def nfc(path: pd.Series) -> pd.Series:
    """Composed Unicode, so that a name is one name however the file system writes its accents."""
    return path.map(lambda p: p if p is None or p.isascii() else unicodedata.normalize("NFC", p))


def preview(c: Column, length: int = 500, always: bool = False) -> Column:
    """The first characters, with dots if something was cut (or always, as the command line shows it)."""
    cut = F.concat(F.substring(c, 1, length), F.lit("..."))
    return cut if always else F.when(F.length(c) > length, cut).otherwise(c)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    """The last suffix in lower case; a dotfile without another suffix is its own name; else empty."""
    name = base_name(path)
    suffix = r"(?s)^\.*[^.].*\.([^.]*)$"
    return F.lower(F.when(name.rlike(suffix), F.regexp_extract(name, suffix, 1)).when(name.rlike(r"(?s)^\.."), F.substring(name, F.lit(2), F.length(name))).otherwise(""))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat_ws("_", stem(path), F.substring(F.sha2(path, 256), 1, 12), index.cast("string"))


@F.pandas_udf(T.StringType())
def content_hash(path: pd.Series, mtime: pd.Series) -> pd.Series:
    """SHA-256 of path and modification time, the time printed as Python prints a float."""
    return pd.Series([None if p is None or m != m else hashlib.sha256(f"{p}:{m!r}".encode()).hexdigest() for p, m in zip(path, (float("nan") if m is None else float(m) for m in mtime), strict=True)])


def ids_hash(ids: Column) -> Column:
    """SHA-256 of the sorted ids, one a line: an aggregate that holds all ids, so for a set of a known size; see set_hash."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "\n"), 256)


def set_hash(ids: Column) -> Column:
    """Fingerprint of any number of ids in any order: their count and the sums of two 60-bit parts of their SHA-256."""
    digest = F.sha2(ids, 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return F.concat_ws("-", F.count(ids).cast("string"), *[F.coalesce(s, F.lit(0).cast("decimal(38,0)")).cast("string") for s in sums])
