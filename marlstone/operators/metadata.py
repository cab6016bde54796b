"""File metadata: path and file system, document properties, patterns in the first page; and the prefix built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import base_name, file_extension, strip

#: Property names by field in order of preference, labels, words of no title, kinds of documents.
PROPERTY_ALIASES = {
    "doc_title": ("title", "제목"),
    "doc_author": ("author", "creator", "작성자"),
    "doc_created": ("created", "creationdate", "creation_date"),
    "doc_modified": ("modified", "moddate", "modification_date"),
    "doc_keywords": ("keywords", "키워드"),
    "doc_subject": ("subject", "주제"),
}
AUTHOR_LABELS = "작성자|담당자|발표자|작성"
DATE_LABELS = "작성일|일시"
TITLE_LABELS = "제목|건명"
DATE = r"(\d{4})[.\-/년]\s*(\d{1,2})[.\-/월]\s*(\d{1,2})일?"
BOILERPLATE = ("보안", "대외비", "비밀", "일반", "confidential", "internal")
DOC_TYPES = ("계획서", "보고서", "회의록", "발표자료", "제안서", "지침", "매뉴얼", "안내서", "결과보고", "실적보고", "사업계획", "연구계획", "백서", "가이드")

FIRST_PAGE = 1000


def _labelled(page: Column, labels: str) -> Column:
    """What stands after the first label and colon, to the end of its line; empty if there is none."""
    return strip(F.regexp_extract(page, rf"(?:{labels})\s*[:：]\s*([^\n]+)", 1))


def author_of(page: Column) -> Column:
    return _labelled(page, AUTHOR_LABELS)


def title_of(page: Column) -> Column:
    """A labelled title of two characters or more, else the first line of 5 to 100 without boilerplate."""
    label = _labelled(page, TITLE_LABELS)
    lines = F.transform(F.split(page, "\n"), strip)
    plain = lambda line: ~line_has(line, BOILERPLATE) & F.length(line).between(5, 100)
    return F.when(F.length(label) >= 2, label).otherwise(F.coalesce(F.get(F.filter(lines, plain), F.lit(0)), F.lit("")))


def line_has(line: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(line)
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return found


def first_date(text: Column) -> Column:
    """The first date of a text as yyyy-MM-dd; empty if there is none or it is not in the calendar."""
    part = lambda k: F.regexp_extract(text, DATE, k)
    stated = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.coalesce(F.date_format(F.try_to_date(stated, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def date_of(page: Column) -> Column:
    """The labelled date if it is one, else the page's first date."""
    labelled = first_date(_labelled(page, DATE_LABELS))
    return F.when(labelled != "", labelled).otherwise(first_date(page))


def doc_type_of(page: Column) -> Column:
    return F.coalesce(*[F.when(page.contains(w), F.lit(w)) for w in DOC_TYPES], F.lit(""))


def property_of(properties: Column, field: str) -> Column:
    """The first of a field's aliases that is not empty; names count in any case and without white space at their ends."""
    normal = F.transform_keys(properties, lambda k, _: F.lower(strip(k)))
    return F.coalesce(*[F.nullif(strip(F.element_at(normal, a)), F.lit("")) for a in PROPERTY_ALIASES[field]], F.lit(""))


def from_path(path: Column, root: str) -> dict[str, Column]:
    prefix = root.rstrip("/") + "/"
    return {"file_name": base_name(path), "file_type": file_extension(path), "relative_path": F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(base_name(path))}


def file_metadata(files: DataFrame, path: str = "file_path", page: str = "first_chunk", properties: str | None = "properties", size: str = "length", modified: str = "mtime", created: str | None = None, root: str = "") -> DataFrame:
    """files with the 13 fields of metadata: the path's and the file system's; properties where they say something; the first page where they don't."""
    text = F.substring(F.coalesce(F.col(page), F.lit("")), 1, FIRST_PAGE)
    known = {f: property_of(F.col(properties), f) if properties else F.lit("") for f in PROPERTY_ALIASES}
    seen = {"doc_title": title_of(text), "doc_author": author_of(text), "doc_created": date_of(text)}
    stamp = lambda c: F.date_format(F.timestamp_micros((F.col(c) * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss")
    out = {f: F.coalesce(F.nullif(c, F.lit("")), seen.get(f, F.lit(""))) for f, c in known.items()}
    out |= {"doc_type": doc_type_of(text), **from_path(F.col(path), root), "file_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "fs_created": stamp(created or modified), "fs_modified": stamp(modified)}
    # the suffix as written, not in lower case
    out["file_type"] = F.regexp_extract(F.col(path), r"[^/.][^/]*\.([^./]*)$", 1)
    return files.withColumns(out)


def context_prefix(title: Column, author: Column, created: Column, modified: Column, file_name: Column, relative_path: Column) -> Column:
    """``[yyyy-MM | title | author | file] ``: what is known, or the folder, or the file name alone, or nothing."""
    text = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    date = F.substring(F.coalesce(text(created), text(modified)), 1, 7)
    parts = F.concat_ws(" | ", date, F.substring(text(title), 1, 50), text(author))
    folder = F.when(relative_path.contains("/"), F.regexp_replace(relative_path, "/[^/]*$", ""))
    inner = F.concat_ws(" | ", F.coalesce(text(parts), text(folder)), text(file_name))
    return F.when(inner != "", F.concat(F.lit("["), inner, F.lit("] "))).otherwise("")
