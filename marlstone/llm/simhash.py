"""SimHash near-duplicates: exact comparison of all fingerprints, tile by tile, as matrices of exclusive-or and bit counts.

A fingerprint holds, bit by bit, what most of a text's shingle hashes have. Two that differ in r bits have population counts
that differ by r at most, and that holds for the counts of their equal parts summed, too. So the distinct fingerprints
lie in cells by the population counts of their parts, cells are cut into tiles of a bounded size, and a tile meets only
those of cells whose counts are within the radius; all other tile pairs are skipped unread. The more fingerprints there
are, the more parts tell cells apart (1, 2, 4 or 8), so that a cell stays about a tile. A tile is one row, and a pair of
tiles gives a spanning forest of its links, so rows don't grow with the pairs that are linked.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import components
from .shared import bounded_batches, kernel_columns, release, remove, written
from .textbytes import LOWER, NOT_SPACE, Spans, window_starts

SEED = 42


def shingles(spans: Spans, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(text, start, end) of every shingle in the slice's words, lower-cased and parted by one space; and these bytes."""
    lens = spans.ends - spans.starts
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    flat = np.full(at[-1], 0x20, np.uint8)
    flat[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = LOWER[spans.data[NOT_SPACE[spans.data]]]
    whole = window_starts(spans.first, width)
    short = np.flatnonzero((spans.counts > 0) & (spans.counts < width))  # all their words are one shingle
    first = np.concatenate((whole, spans.first[short]))
    last = np.concatenate((whole + width - 1, spans.first[short] + spans.counts[short] - 1))
    doc = np.concatenate((spans.doc[whole], short))
    order = np.argsort(doc, kind="stable")
    first, last = first[order], last[order]
    return doc[order], at[first], at[last] + lens[last], flat.tobytes()


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3, step: int = 1 << 17) -> np.ndarray:
    """64-bit fingerprints of texts (UTF-8 bytes and offsets); a text without words has zero."""
    import xxhash

    spans = Spans(data, offsets, NOT_SPACE)
    doc, start, end, flat = shingles(spans, width)
    n = len(offsets) - 1
    ones = np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(doc), step):
        d = doc[k : k + step]
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(start[k : k + step].tolist(), end[k : k + step].tolist(), strict=True)), np.uint64, len(d))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        ones[d[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    most = 2 * ones > np.bincount(doc, minlength=n)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def parts_for(n: int, tile: int) -> int:
    """Into how many parts fingerprints are cut so that n of them, were their bits even, lie `tile` a cell or fewer."""
    for parts in (1, 2, 4):
        if n <= tile * (2 * math.pi * math.e * 16 / parts) ** (parts / 2):
            return parts
    return 8


def offsets_within(parts: int, radius: int) -> list[int]:
    """The differences of packed counts of cells to be compared: of each pair of opposite ones the one that is not negative."""
    found = []
    for v in itertools.product(range(-radius, radius + 1), repeat=parts) if parts <= 4 else _sparse(parts, radius):
        if sum(map(abs, v)) <= radius:
            found.append(sum(x << (8 * k) for k, x in enumerate(v)))
    return sorted(x for x in found if x >= 0)


def _sparse(parts: int, radius: int):
    """Vectors of at most `radius` steps."""
    layer = {(0,) * parts}
    seen = set(layer)
    for _ in range(radius):
        layer = {v[:k] + (v[k] + s,) + v[k + 1 :] for v in layer for k in range(parts) for s in (-1, 1)} - seen
        seen |= layer
    return seen


def forest(x: np.ndarray, y: np.ndarray, radius: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x and y, one after the other) of a spanning forest of all pairs of x and y that differ in radius bits at most."""
    n = len(x) + len(y)
    label = np.arange(n)
    a_out, b_out = [], []
    step = max(1, cells // max(1, len(y)))
    for k in range(0, len(x), step):
        a, b = np.nonzero(np.bitwise_count(x[k : k + step, None] ^ y[None, :]) <= radius)
        a, b = a + k, b + len(x)
        while len(a):
            ra, rb = label[a], label[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            high, at = np.unique(np.maximum(ra, rb), return_index=True)  # each root hangs on one that is less
            a_out.append(a[at])
            b_out.append(b[at])
            up = np.arange(n)
            up[high] = np.minimum(ra, rb)[at]
            while True:
                higher = up[up]
                if np.array_equal(higher, up):
                    break
                up = higher
            label = up[label]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (none, none)


def links(nodes: DataFrame, radius: int = 3, tile: int = 4096, parts: int | None = None) -> DataFrame:
    """a, b: links that join what all pairs of nodes (fp, distinct) within the radius join. nodes is read more than once."""
    if parts is None:
        parts = parts_for(nodes.count(), tile)
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(mask)).cast("long") for k in range(parts)]
    cell = sum((F.shiftleft(c, 8 * k) for k, c in enumerate(counts)), F.lit(0).cast("long"))
    placed = nodes.select("fp", cell.alias("cell"))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("n"))
    if parts <= 4:  # 17^4 cells at most; to meet by cell, all of a common one would pass one task
        blocks = F.broadcast(blocks)
    placed = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("fp"), "n").alias("block"), "fp")

    def pack(table: pa.Table) -> pa.Table:
        own = np.sort(table["fp"].to_numpy())
        return pa.table([table["cell"][:1], table["block"][:1], pa.array([own.tobytes()], pa.binary())], names=["cell", "block", "fps"])

    tiles = written(placed.groupBy("cell", "block").applyInArrow(pack, "cell long, block long, fps binary"), "tiles")
    steps = F.explode(F.array(*[F.lit(x).cast("long") for x in offsets_within(parts, radius)]))
    right = tiles.select(steps.alias("step"), "cell", "block", "fps").select((F.col("cell") - F.col("step")).alias("cell"), "step", F.col("block").alias("other"), F.col("fps").alias("theirs"))
    pairs = tiles.join(right, "cell").where("step <> 0 or block <= other").select("fps", "theirs")

    def compare(batches):
        for batch in batches:
            a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.int64) for s in (mine, theirs))
                a, b = forest(x.view(np.uint64), y.view(np.uint64), radius)
                both = np.concatenate((x, y))
                a_out.append(both[a])
                b_out.append(both[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])
            release()

    bounded_batches(nodes.sparkSession)
    found = written(pairs.mapInArrow(compare, "a long, b long").where("a <> b"), "links")
    remove(tiles)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, tile: int = 4096) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reached over links).

    Words are runs that are not ASCII white space; only A to Z are lower-cased. Null and empty texts and those of white space
    have the fingerprint zero and are linked like any other; a bit that just half of the hashes have is 0. Texts of equal
    fingerprints are one node, so copies cost nothing in the comparison. Rows that repeat an id each get a row; null ids
    are in their class without naming it (component_id is null only in a class of none but null ids). A text of any
    length is hashed whole, in steps of bounded memory. Other columns are ignored; an empty table gives no rows.
    """
    made = kernel_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", [T.StructField("fp", T.LongType())], lambda: lambda data, offsets, nulls: [fingerprints(data, offsets, width).view(np.int64)], ["doc_id"], 1 << 20)
    signed = written(made, "fingerprints")
    nodes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes, radius, tile)
    comp = components(edges)
    placed = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    placed = written(placed, "placed")
    named = placed.join(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("fp", "component_id")
    named = written(named, "named")
    remove(nodes, edges, placed)
    return signed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
