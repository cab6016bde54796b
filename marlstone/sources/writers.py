"""Small files of the formats that the extractors read, made of texts: for tests and for the named queries."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(text: str, cells: list[str], title: str = "") -> bytes:
    """Lines as paragraphs, then a table of one row."""
    p = lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{escape(t)}</w:t></w:r></w:p>"
    row = "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells)
    core = f"<c:coreProperties xmlns:c='urn:c' xmlns:dc='urn:dc'><dc:title>{escape(title)}</dc:title></c:coreProperties>"
    return zipped({"word/document.xml": f"<w:document xmlns:w='{WORD}'><w:body>{''.join(map(p, text.split(chr(10))))}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>", "docProps/core.xml": core})


def pptx(slides: list[str]) -> bytes:
    """One text box a slide."""
    return zipped({f"ppt/slides/slide{k}.xml": f"<p:sld xmlns:a='urn:a' xmlns:p='urn:p'><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{escape(s)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>" for k, s in enumerate(slides, 1)})


def xlsx(name: str, rows: list[list[str]]) -> bytes:
    """One sheet of inline strings."""
    cell = lambda r, k, v: f"<c r='{chr(65 + k)}{r}' t='inlineStr'><is><t>{escape(v)}</t></is></c>"
    data = "".join(f"<row r='{r}'>{''.join(cell(r, k, v) for k, v in enumerate(row) if v)}</row>" for r, row in enumerate(rows, 1))
    book = f"<workbook xmlns:r='urn:r'><sheets><sheet name='{escape(name)}' r:id='r1'/></sheets></workbook>"
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{data}</sheetData></worksheet>"})


def hwpx(paragraphs: list[str]) -> bytes:
    return zipped({"Contents/content.xml": "<a>" + "".join(f"<p>{escape(p)}</p>" for p in paragraphs) + "</a>"})


def bundle(first: str, second: str) -> bytes:
    return zipped({"index.xml": f"<a>{escape(first)}<b>{escape(second)}</b></a>"})


def compound(streams: dict[str, bytes]) -> bytes:
    """An OLE compound file of streams ``name`` or ``storage/name``; all in whole sectors, none in the small stream."""
    free, end, fat_mark, size = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 512
    tree = [("Root Entry", 5, None)]
    for folder in dict.fromkeys(n.split("/")[0] for n in streams if "/" in n):
        tree.append((folder, 1, None))
    tree += [(n, 2, d) for n, d in streams.items()]
    at = {n: k for k, (n, _, _) in enumerate(tree)}
    in_root = [k for k, (n, _, _) in enumerate(tree) if k and "/" not in n]
    kids = {0: in_root} | {at[f]: [k for k, (n, _, _) in enumerate(tree) if n.startswith(f + "/")] for f, kind, _ in tree if kind == 1}
    right = {a: b for own in kids.values() for a, b in zip(own, own[1:], strict=False)}
    n_dir = -(-len(tree) * 128 // size)
    lengths = [-(-len(d) // size) for _, _, d in tree if d is not None]
    n_fat = 1
    while n_fat * (size // 4) < n_fat + n_dir + sum(lengths):
        n_fat += 1
    fat = [fat_mark] * n_fat + [n_fat + k + 1 for k in range(n_dir - 1)] + [end]
    entries, body = [], []
    for k, (name, kind, data) in enumerate(tree):
        own = name.split("/")[-1].encode("utf-16-le") + b"\0\0"
        start, length = (0, 0) if data is None else (len(fat), len(data))
        if data is not None:
            n = -(-len(data) // size)
            fat += [len(fat) + j + 1 for j in range(n - 1)] + [end] * (n > 0)
            body.append(data.ljust(n * size, b"\0"))
        entries.append(own.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(own), kind, 1, free, right.get(k, free), kids.get(k, [free])[0] if kids.get(k) else free, start, length))
    fat += [free] * (n_fat * (size // 4) - len(fat))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + struct.pack("<16xHHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, n_fat, n_fat, 0, 0, end, 0, end, 0)
    head += struct.pack("<109I", *[k if k < n_fat else free for k in range(109)])
    return head + struct.pack(f"<{len(fat)}I", *fat) + b"".join(entries).ljust(n_dir * size, b"\0") + b"".join(body)


def hwp(paragraphs: list[str]) -> bytes:
    """A word processor file: one compressed body section, a record a paragraph."""
    records = []
    for p in paragraphs:
        data = p.encode("utf-16-le")
        records.append((struct.pack("<II", 67 | 0xFFF << 20, len(data)) if len(data) >= 0xFFF else struct.pack("<I", 67 | len(data) << 20)) + data)
    packer = zlib.compressobj(wbits=-15)
    body = packer.compress(b"".join(records)) + packer.flush()
    return compound({"FileHeader": b"HWP Document File".ljust(36, b"\0") + b"\1" + bytes(219), "BodyText/Section0": body})


def written(make: Callable[..., bytes], *columns: Column) -> Column:
    """The file that make(row's values) gives."""

    @F.pandas_udf(T.BinaryType())
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([make(*row) for row in zip(*values, strict=True)], dtype=object)

    return run(*columns)
