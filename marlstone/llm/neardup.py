"""Near-duplicate classes: BagMinHash signatures, bands, verified multiset overlap, connected components.

A document is the bag of its word shingles. For each shingle, a hierarchy of Poisson processes covers the discretised
weights: (0,1], (1,2], (2,4], (4,8], ...; a bag of weight w takes the points of the intervals below w, and of the interval
that holds w those whose level is at most w. A point hits one register; a register keeps its first point, so registers
agree with the probability of the weighted Jaccard similarity. Points come in order of time, and a shingle is done once
its next one is later than every register's.

Texts of equal words are one node. Nodes that share a band's bucket are linked to the bucket's first node, each to the
one it shares most bands with, and a link counts once the bags' true overlap is verified. What is still apart then is
compared across components: a bucket within one component gives no more pairs, so a group of copies costs in proportion
to its size, while no pair of different components is left out (but for those whose signatures differ so much that the
similarity cannot be near the threshold). Buckets of many documents that share much and yet stay apart are cut into
blocks; a task compares two blocks' sketches as matrices, each pair in the first bucket it shares, and a second pass
fetches the texts of nodes that any such pair needs and gives a spanning forest of the links it finds, so that neither
rows nor memory grow with the pairs. Everything between the steps lies in written
tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, fresh, kernel_columns, ragged, release, remove, written
from .textbytes import ALNUM, LOWER, Spans, U, mix, of_texts, utf8_column, window_hashes, window_starts

_G, _R, _L = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)


def bags(spans: Spans, width: int = 5):
    """(text, shingle, weight) sorted by text: shingles of `width` words; a text of fewer words, but not none, is one."""
    hashes = spans.hashes(LOWER)
    starts = window_starts(spans.first, width)
    docs, keys = [spans.doc[starts]], [window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)]
    for n in range(1, width):
        short = np.flatnonzero(spans.counts == n)
        if len(short):
            docs.append(short)
            keys.append(window_hashes(hashes, n)[spans.first[short]])
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """m 64-bit registers a text; a text without shingles has zeros."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(int)  # intervals 0..levels
    item = np.repeat(np.arange(len(key)), levels + 1)
    interval = np.arange(len(item)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    low = np.where(interval == 0, 0, 1 << np.maximum(interval - 1, 0))
    size = np.where(interval == 0, 1, low)
    d, w = doc[item], weight[item]
    state = mix(key[item] + interval.astype(np.uint64) * _G)
    time = np.zeros(len(item))
    first = np.full(n_docs * m, np.inf)
    out = np.zeros(n_docs * m, np.uint64)
    latest = np.full(n_docs, np.inf)
    while len(d):
        state = mix(state + _G)
        time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        alive = time < latest[d]
        if not alive.all():
            d, w, state, time, low, size = d[alive], w[alive], state[alive], time[alive], low[alive], size[alive]
            if not len(d):
                break
        point = mix(state ^ _R)
        register = d * m + ((point >> U(32)) * U(m) >> U(32)).astype(np.int64)
        level = low + 1 + ((mix(point ^ _L) >> U(33)).astype(np.float64) * 2.0**-31 * size).astype(np.int64)
        better = np.flatnonzero((level <= w) & (time < first[register]))
        if len(better):
            better = better[np.argsort(-time[better], kind="stable")]
            first[register[better]] = time[better]  # the last written, the earliest, stays
            out[register[better]] = point[better]
            touched = np.unique(d[better])
            latest[touched] = first.reshape(n_docs, m)[touched].max(axis=1)
    return out.reshape(n_docs, m)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    n, m = registers.shape
    rows = registers.reshape(n, bands, m // bands)
    h = np.full((n, bands), U(1)) * (np.arange(bands, dtype=np.uint64) + U(1)) * _G
    for k in range(m // bands):
        h = mix(h + rows[:, :, k])
    return h


FIELDS = [T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]


def _sign(bands: int, rows: int, width: int):
    def kernel(data, offsets, nulls):
        spans = Spans(data, offsets, ALNUM)
        n = len(spans.counts)
        doc, key, weight = bags(spans, width)
        registers = signatures(doc, key, weight, n, bands * rows)
        f1, f2 = prints(spans)
        has = spans.counts > 0
        h = band_hashes(registers, bands)[has]
        sketch = (registers & U(255)).astype(np.uint8)
        return [f1.view(np.int64), f2.view(np.int64), spans.counts, ragged(h.reshape(-1).view(np.int64), np.where(has, bands, 0), pa.int64()), pa.array([r.tobytes() for r in sketch], pa.binary())]

    return kernel


def prints(spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's words in order."""
    h = spans.hashes(LOWER)
    at = (np.arange(len(h)) - spans.first[:-1][spans.doc]).astype(np.uint64)
    out = []
    for salt in (_R, _L):
        x = mix(mix(h ^ salt) + mix(at * _G + salt))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out.append(mix(total[spans.first[1:]] - total[spans.first[:-1]] + spans.counts.astype(np.uint64)))
    return out[0], out[1]


def overlap(a: list, b: list, width: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of a[i] and b[i]."""
    spans = Spans(*of_texts([*a, *b]), ALNUM)
    doc, key, weight = bags(spans, width)
    n = len(a)
    pair = doc % n
    order = np.lexsort((key, pair))
    pair, key, weight = pair[order], key[order], weight[order].astype(np.float64)
    same = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
    low = np.bincount(pair[1:][same], np.minimum(weight[1:][same], weight[:-1][same]), n)
    total = np.bincount(pair, weight, n)
    return np.where(total > 0, low / np.maximum(total - low, 1e-9), 0.0)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of every node of edges (a, b), by alternating large and small stars."""
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while not _are_stars(stars):
        two = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = two.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        linked = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        nxt = written(linked.distinct(), "stars")
        remove(stars)
        stars = nxt
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root at most, and no root on another."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 5, slack: float = 0.2, block: int = 640, few: int = 24) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), class_size.

    Words are lower-cased runs of letters and digits (all beyond ASCII count as such). Documents of the same words are
    in one class; others whose bags overlap by `threshold` are linked, and classes are the components of links. A null
    text or one without words is a class of its own. Rows that repeat an id each get a row; null ids are in their
    class without naming it (class_id is null only in a class of none but null ids). Other columns are ignored; an empty
    table gives no rows. A text of any length is signed whole, in a slice of its own. A pair of just the threshold is linked;
    the class is named by the least id, whatever the order of rows. `slack` is how far below the threshold a pair's signature estimate may lie and still be verified;
    buckets still open with over `few` nodes are compared in blocks of about `block`.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    made = kernel_columns(docs, "text", FIELDS, lambda: _sign(bands, rows, width), ["doc_id", "th"], 1 << 19)
    signed = written(made.withColumn("rid", F.monotonically_increasing_id()), "signed")
    whole = signed.where("size > 0").groupBy("f1", "f2").agg(F.min("rid").alias("node"))
    nodes = written(signed.join(whole.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "doc_id", "th", "f1", "f2", "bands", "sketch"), "nodes")
    filled = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = filled.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    buckets = written(filled.join(heads, "bucket"), "buckets")
    texts = _texts(docs, nodes, buckets)
    # each node to the head it shares most bands with
    stars = buckets.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("k"))
    best = stars.groupBy("node").agg(F.max_by("head", F.struct("k", -F.col("head"))).alias("head"))
    links = [written(_verify(_near(best.select(F.col("node").alias("a"), F.col("head").alias("b")), nodes, threshold - slack), texts, threshold, width), "links")]
    # a node's head and that head's head are of its component; the other heads may be apart
    up = links[0].select("a", "b").join(links[0].select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left")
    comp = written(up.select(F.col("a").alias("node"), F.coalesce("c", "b").alias("comp")), "comp")
    more = _apart(stars.select(F.col("node").alias("a"), F.col("head").alias("b")), comp)
    links.append(written(_verify(_near(more, nodes, threshold - slack), texts, threshold, width), "links"))
    comp2 = written(components(links[0].union(links[1])), "comp")
    remove(comp)
    # all pairs of one bucket and different components
    placed = buckets.select("bucket", "node").join(comp2, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x < y").select("bucket", "n")
    rest = written(placed.join(open_, "bucket"), "open")
    small = rest.where(F.col("n") <= few)
    left, right = small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca")), small.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"))
    pairs = left.join(right, "bucket").where("ca < cb").select("a", "b").distinct()
    links.append(written(_verify(_near(pairs, nodes, threshold - slack), texts, threshold, width), "links"))
    links.append(_compare_blocks(rest.where(F.col("n") > few), nodes, texts, threshold, slack, width, block))
    # what the last links join, component by component
    late = links[2].union(links[3]).select("a", "b")
    ca, cb = comp2.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp2.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    ends = late.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("last"))
    named = whole.join(comp2, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("comp")).join(joined, "comp", "left").select("f1", "f2", F.coalesce("last", "comp").alias("comp"))
    # texts without words look for no class, and must not meet in one task
    rows_ = signed.select("rid", "doc_id", "size", "f1", F.when(F.col("size") > 0, F.col("f2")).otherwise(F.col("rid")).alias("f2")).join(named, ["f1", "f2"], "left")
    rows_ = rows_.select("doc_id", F.when(F.col("size") > 0, F.col("comp")).otherwise(F.col("rid")).alias("comp"))
    rows_ = written(rows_, "classed")
    least = rows_.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = rows_.join(least, "comp").select("doc_id", "class_id", "class_size")
    remove(signed, nodes, buckets, texts, rest, comp2, *links)
    return out


def _texts(docs: DataFrame, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """node, text of the nodes that share a bucket."""
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return written(found.groupBy("node").agg(F.any_value("text").alias("text")), "texts")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes are in different components so far."""
    ca, cb = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    out = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


@F.pandas_udf(T.DoubleType())
def _agree(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype=float)
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
    return pd.Series((a == b).mean(axis=1))


def _block_pairs(t: pa.Table, least: float):
    """The rows of a task's two blocks, and which pairs of them its bucket has to compare: of different components, with
    sketches that agree at `least`, and with no earlier band in common."""
    blk, node, comp = (t[c].to_numpy() for c in ("blk", "node", "comp"))
    i, j, bucket = t["i"][0].as_py(), t["j"][0].as_py(), t["bucket"][0].as_py()
    band = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
    x, y = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
    need = comp[x][:, None] != comp[y][None, :]
    if i == j:
        need &= node[x][:, None] < node[y][None, :]
    agree = np.zeros(need.shape, np.float32)
    for k in range(sketch.shape[1]):
        agree += sketch[x, k][:, None] == sketch[y, k][None, :]
    need &= agree >= least * sketch.shape[1]
    todo = need.copy()
    for k in range(band.shape[1]):  # up to the first band a pair shares
        same = todo & (band[x, k][:, None] == band[y, k][None, :])
        need[same] = band[x, k][np.nonzero(same)[0]] == bucket
        todo &= ~same
    return x, y, need


def _compare_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, slack: float, width: int, block: int) -> DataFrame:
    """a, b, similarity: of members (bucket, node, comp, n) links across components, enough to join what any link joins.

    A first pass sends sketches alone, and says which nodes of a pair of blocks any pair needs; only their texts follow.
    """
    g = F.ceil(F.col("n") / block)
    own = members.withColumn("blk", F.pmod(F.xxhash64("node"), g).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (g - 1).cast("int"))))
    own = own.select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "comp")
    signed = nodes.select("node", "bands", "sketch")
    columns = ["bucket", "i", "j", "blk", "node", "comp", "bands", "sketch"]
    schema = "bucket long, i int, j int, blk int, node long, comp long, bands array<long>, sketch binary"

    def needed(table: pa.Table) -> pa.Table:
        x, y, need = _block_pairs(table, threshold - slack)
        out = table.take(np.union1d(x[need.any(axis=1)], y[need.any(axis=0)]))
        release()
        return out

    def run(table: pa.Table) -> pa.Table:
        x, y, need = _block_pairs(table, threshold - slack)
        node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
        s = overlap_matrix(table["text"].to_pylist(), x, y, width)
        rows: list[tuple[int, int, float]] = []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for p, q in zip(*np.nonzero(need & (s >= threshold - 1e-12)), strict=True):
            a, b = root(int(comp[x[p]])), root(int(comp[y[q]]))
            if a != b:
                parent[b] = a
                rows.append((int(node[x[p]]), int(node[y[q]]), float(s[p, q])))
        out = list(zip(*rows, strict=True)) if rows else [[], [], []]
        release()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    some = written(own.join(signed, "node").select(*columns).groupBy("bucket", "i", "j").applyInArrow(needed, schema), "needed")
    full = some.join(texts, "node").select(*columns, "text")
    links = written(full.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long, similarity double"), "links")
    remove(some)
    return links


def overlap_matrix(texts: list, x: np.ndarray, y: np.ndarray, width: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of texts[x] with those of texts[y]; only shared shingles cost."""
    doc, key, weight = bags(Spans(*of_texts(texts), ALNUM), width)
    size = np.bincount(doc, weight, len(texts))
    order = np.argsort(key, kind="stable")
    doc, key, weight = doc[order], key[order], weight[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.append(start[1:], len(key))
    shared = end - start > 1
    at_x, at_y = np.full(len(texts), -1), np.full(len(texts), -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    low = np.zeros((len(x), len(y)))
    for a, b in zip(start[shared].tolist(), end[shared].tolist(), strict=True):
        d, w = doc[a:b], weight[a:b]
        px, py = at_x[d], at_y[d]
        mx, my = px >= 0, py >= 0
        if mx.any() and my.any():
            low[np.ix_(px[mx], py[my])] += np.minimum(w[mx][:, None], w[my][None, :])
    total = size[x][:, None] + size[y][None, :] - low
    return np.divide(low, total, out=np.zeros_like(low), where=total > 0)


def _near(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sketches agree often enough."""
    sa, sb = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").where(_agree("sa", "sb") >= least).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, members: int = 64, size: int = 8 << 20) -> DataFrame:
    """a, b, similarity of the pairs whose bags overlap by the threshold.

    A b of more than `members` partners, or of `size` bytes of them, is parted by a salt into groups of about so many; its text
    goes to each group once, and is not copied a partner.
    """
    sizes = texts.select(F.col("node").alias("a"), F.octet_length("text").alias("n"))
    load = pairs.join(sizes, "a").groupBy("b").agg(F.ceil(F.greatest(F.count("*") / members, F.sum("n") / size)).alias("salts"))
    many = written(load.where("salts > 1"), "many")
    few = _verify_joined(pairs.join(many, "b", "left_anti"), texts, threshold, width)
    placed = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").alias("salt"))
    ta, tb = texts.select(F.col("node").alias("a"), "text"), texts.select(F.col("node").alias("b"), "text")
    own = placed.join(ta, "a").select("b", "salt", "a", "text")
    heads = placed.select("b", "salt").distinct().join(tb, "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")

    def run(table: pa.Table) -> pa.Table:
        node = table["a"].combine_chunks()
        head = int(np.flatnonzero(node.is_null().to_numpy(zero_copy_only=False))[0])
        others = np.flatnonzero(node.is_valid().to_numpy(zero_copy_only=False))
        text, rows = table["text"][head].as_py(), []
        lengths = np.array([len(table["text"][int(k)].as_py()) for k in others])
        for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(lengths) // (1 << 21))) + 1):  # long ones one by one
            if len(part):
                rows.append(overlap([table["text"][int(k)].as_py() for k in part], [text] * len(part), width))
        s = np.concatenate(rows) if rows else np.zeros(0)
        good = s >= threshold - 1e-12
        release()
        kept = pa.array(others[good])
        return pa.table([node.take(kept), table["b"].combine_chunks().take(kept), pa.array(s[good])], names=["a", "b", "similarity"])

    return few.unionByName(own.unionByName(heads).groupBy("b", "salt").applyInArrow(run, "a long, b long, similarity double"))


def _verify_joined(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """_verify for b of few partners: both texts of each pair in a row, many pairs at a time."""
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            sizes = sum(np.diff(utf8_column(batch.column(k))[1]) for k in (2, 3)) if batch.num_rows else np.zeros(0)
            part = (np.cumsum(sizes) // (1 << 21)).astype(int) if len(sizes) else sizes
            for k in np.unique(part):
                rows = batch.slice(int(np.searchsorted(part, k)), int((part == k).sum()))
                s = overlap(rows.column(2).to_pylist(), rows.column(3).to_pylist(), width)
                good = pa.array(s >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(good), rows.column(1).filter(good), pa.array(s).filter(good)], names=["a", "b", "similarity"])
            release()

    bounded_batches(pairs.sparkSession)
    return joined.mapInArrow(run, "a long, b long, similarity double")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, that with the least id, and of rows with that id one; the columns stay as they are."""
    found = classes(docs, id_col, text_col, **options)
    own = fresh("_kept", docs.columns)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n"))
    match = docs[id_col].eqNullSafe(F.col(own))
    once = docs.join(kept.where("n = 1").select(own), match, "left_semi")
    more = docs.join(kept.where("n > 1").select(own), match, "left_semi").dropDuplicates([id_col])
    return once.unionByName(more)
