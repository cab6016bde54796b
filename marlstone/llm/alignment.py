"""Alignment of two tokenizers' tokens by byte offsets: groups that both end at once, and how often two ids end together.

A text is cut before blanks and line ends that follow something else, where no token of either tokenizer crosses; so each
distinct piece is encoded and aligned once a Python worker, as long as it is met again. DuckDB aligns a batch's new pieces: their tokens are tables of byte
intervals; an ASOF join gives each B token the A token that its last byte is in, which are cut where both end; sums
over windows number the groups; a range join deals the A tokens out to the groups' byte ranges. A text's result is the sum over
its pieces. Pair counts are summed within each task by DuckDB and merged by Spark.

Tokens that end together, at the same text, are one the end of the other. So the pairs that can ever be linked follow from
the two vocabularies alone, and that proves a bound of the pair table, which is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, ragged, release, remove, written
from .textbytes import byte_set, row_slices, utf8_column

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokens of a byte-level BPE of `tokenizers`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_level()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            self.bytes[k] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()

    def ids(self, text: str) -> list[int]:
        """Of a text that begins with a blank."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # no offsets are made


class Pieces:
    """Tokens of a sentencepiece model that puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes = [bytes([int(m.id_to_piece(k)[3:5], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace("▁", " ").encode() for k in range(m.get_piece_size())]
        self.can_cut = not any(b"\n" in p or b" " in p.lstrip(b" ") for k, p in enumerate(self.bytes) if not m.is_byte(k))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:])


def linkable(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of entries are one the end of the other: no more pairs of ids can ever end together."""
    n = 0
    for these, those, least in ((a, b, 0), (b, a, 1)):  # equal ones count once
        ends: dict[bytes, int] = {}
        for x in those:
            ends[x] = ends.get(x, 0) + 1
        n += sum(ends.get(x[k:], 0) for x in these for k in range(least, len(x)))
    return n


_BLANK, _SPACE = byte_set(0x20, 0x0A), byte_set(0x20, (0x09, 0x0D))
#: Last bytes of characters that are white space in no tokenizer: ASCII ones, and (by their first byte) those beyond U+00BF
#: but for the blocks that hold U+1680, U+2000 to U+205F and U+3000.
_GRAPH, _LEAD = byte_set((0x21, 0x7E)), byte_set((0xC3, 0xDF), (0xE4, 0xF4))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, in ascending order: at texts' beginnings, and before blanks after what is no white space, but for
    white space that a text ends with."""
    n = len(data)
    at = np.flatnonzero(_BLANK[data[1:]] & ~_SPACE[data[:-1]]) + 1 if n else np.zeros(0, np.int64)
    good = _GRAPH[data[at - 1]]
    for back in (2, 3, 4):  # the first byte of the character before
        lead = data[np.maximum(at - back, 0)]
        high = np.all([data[np.maximum(at - k, 0)] >> 6 == 2 for k in range(1, back)], axis=0)
        good |= high & _LEAD[lead] & (lead >> 6 == 3)
    at = at[good]
    solid = np.flatnonzero(~_SPACE[data])
    last = solid[np.maximum(np.searchsorted(solid, offsets[1:]) - 1, 0)] if len(solid) else np.zeros(len(offsets) - 1, np.int64)
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[(at < last[text]) & (at > offsets[text])]
    return np.union1d(offsets[:-1][np.diff(offsets) > 0], at)


#: Tokens of A and B are tables a, b (id, s, e), pieces p (k, s). Steps are tables of their own, so that joins know their sizes.
STEPS = [
    """create or replace temp table numbered as
       with at_end as (select b.id, b.s, b.e, a.id as a_id, a.e = b.e as cut from b asof join a on b.e > a.s)
       select *, coalesce(sum(cut::int) over (order by e rows between unbounded preceding and 1 preceding), 0)::bigint as g from at_end""",
    """create or replace temp table ranges as
       select g, min(s) as lo, max(e) as hi, arg_max(a_id * 32768 + id, e)::bigint as pair, count(*) as n_b from numbered group by g""",
    """create or replace temp table dealt as
       select a.id, a.e, a.e = r.hi as cut, r.g from a join ranges r on a.s >= r.lo and a.s < r.hi""",
]
GROUPS = """select p.k, n_a, n_b, pair from ranges r join (select g, count(*) as n_a from dealt group by g) using (g) asof join p on r.lo >= p.s order by r.g"""
TEXT = """select id || sep as t from (
    select g, 0 as side, e, id, case when cut then '|' else ',' end as sep from dealt union all
    select g, 1, e, id, case when cut then ';' else ',' end from numbered) order by g, side, e"""


class Aligner:
    """Aligned pieces, each distinct one once. Of more than `most` those stay that were met twice since there were as many."""

    _shared: dict[tuple, Aligner] = {}

    @classmethod
    def shared(cls, a_path: str, b_path: str) -> Aligner:
        """One a Python worker, whatever the task: its pieces serve the next task, too."""
        if (a_path, b_path) not in cls._shared:
            cls._shared[a_path, b_path] = cls(ByteLevel(a_path), Pieces(b_path))
        return cls._shared[a_path, b_path]

    def __init__(self, a: ByteLevel, b: Pieces, most: int = 300_000):
        import duckdb

        self.a, self.b, self.most = a, b, most
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        self.at: dict[bytes, int] = {}
        self.good, self.n_a, self.n_b, self.met = np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
        self.groups: list[bytes] = []
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def shrink(self):
        kept = np.flatnonzero(self.met > 1)
        kept = kept if 2 * len(kept) < self.most else kept[:0]
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        place = place.tolist()
        self.at = {name: place[k] for name, k in self.at.items() if place[k] >= 0}
        self.groups = [self.groups[k] for k in kept.tolist()]
        size = (self.first[1:] - self.first[:-1])[kept]
        self.pairs = self.pairs[np.arange(int(size.sum())) + np.repeat(self.first[kept] - (np.cumsum(size) - size), size)]
        self.first = np.append(0, np.cumsum(size))
        self.good, self.n_a, self.n_b, self.met = self.good[kept], self.n_a[kept], self.n_b[kept], np.zeros(len(kept), np.int64)

    def places(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each piece's place among those kept; new ones are aligned. Those that end with white space, at a text's end, are
        encoded by themselves."""
        at = self.at
        found = [at.get(raw[s:e], -1) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        out = np.array(found, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            names: dict[bytes, bool] = {}
            for k in new.tolist():
                names.setdefault(raw[begins[k] : ends[k]], False)
            self._add(list(names))
            out[new] = [at[raw[begins[k] : ends[k]]] for k in new.tolist()]
        self.met += np.bincount(out, minlength=len(self.met))
        return out

    def _add(self, names: list[bytes], size: int = 1 << 18):
        start, part, held = len(self.groups), [], 0
        good, tokens = [], ([], [])
        for x in names:
            joinable = not _SPACE[x[-1]]
            if not joinable or held > size:
                self._encode(part, good, tokens)
                part, held = [], 0
            if joinable:
                part.append(x)
                held += len(x)
            else:
                self._encode([x], good, tokens)
        self._encode(part, good, tokens)
        n = len(names)
        n_a, n_b, groups, lens, flat = self._align(names, np.array(good, bool), *tokens)
        self.good = np.append(self.good, np.array(good, bool))
        self.n_a, self.n_b, self.met = np.append(self.n_a, n_a), np.append(self.n_b, n_b), np.append(self.met, np.zeros(n, np.int64))
        self.groups += groups
        self.first = np.append(self.first, self.first[-1] + np.cumsum(lens))
        self.pairs = np.append(self.pairs, flat)
        self.at.update(zip(names, range(start, start + n), strict=True))

    def _encode(self, part: list[bytes], good: list, tokens: tuple[list, list]):
        """Tokens of pieces, encoded as one text after a letter; if their bytes come out differently, half by half."""
        if not part:
            return
        text = b" x" + b"".join(part)
        found = []
        for t in (self.a, self.b):
            ids = np.array(t.ids(text.decode("utf-8", "replace")), np.int64)
            made = [t.bytes[k] for k in ids.tolist()]
            if b"".join(made) != text:
                break
            ends = np.cumsum([len(m) for m in made])
            skip = int(np.searchsorted(ends, 2)) + 1  # the tokens of the letter
            bounds = np.cumsum([2, *map(len, part)])
            stops = np.searchsorted(ends, bounds)
            if not np.array_equal(ends[np.minimum(stops, len(ends) - 1)], bounds):
                raise RuntimeError("a token crosses a cut")
            found.append((ids[skip:], ends[skip:] - 2))
        if len(found) == 2:
            good += [True] * len(part)
            for kept, f in zip(tokens, found, strict=True):
                kept.append((f[0], f[1], sum(map(len, part))))
        elif len(part) == 1:
            good.append(False)
        else:
            for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                self._encode(half, good, tokens)

    def _align(self, names: list[bytes], good: np.ndarray, a: list, b: list):
        n = len(names)
        n_a, n_b, lens = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        groups = [b""] * n
        if not good.any():
            return n_a, n_b, groups, lens, np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, names), np.int64, n)[good]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        for name, parts in (("a", a), ("b", b)):
            base = np.concatenate(([0], np.cumsum([p[2] for p in parts])))[:-1]
            ids = np.concatenate([p[0] for p in parts])
            e = np.concatenate([p[1] + x for p, x in zip(parts, base, strict=True)])
            self.db.register(name, pa.table({"id": ids, "s": np.append(0, e[:-1]), "e": e}))
        self.db.register("p", pa.table({"k": np.flatnonzero(good), "s": begin[:-1]}))
        for step in STEPS:
            self.db.execute(step)
        found = self.db.sql(GROUPS).fetchnumpy()
        text, at = utf8_column(self.db.sql(TEXT).to_arrow_table()["t"])
        for name in ("a", "b", "p"):
            self.db.unregister(name)
        k = np.asarray(found["k"])
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        own = k[heads]  # a piece's groups follow each other
        lens[own] = np.diff(np.append(heads, len(k)))
        n_a[own], n_b[own] = np.add.reduceat(found["n_a"], heads), np.add.reduceat(found["n_b"], heads)
        edge = at[np.append(0, np.cumsum((n_a + n_b)[own]))]
        raw = text.tobytes()
        for place, b, e in zip(own.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            groups[place] = raw[b : e - 1]
        return n_a, n_b, groups, lens, np.asarray(found["pair"])

    def take(self, data: np.ndarray, offsets: np.ndarray, nulls: np.ndarray, step: int = 1 << 17):
        """Of a slice's texts, as they are: n_a, n_b, n_groups, digest of the groups, and pairs of ids with their links' counts."""
        n = len(nulls)
        lens = np.diff(offsets)
        own = np.flatnonzero(lens > 0)
        at = offsets[own] + np.arange(len(own))  # a blank goes before each text
        spaced = np.insert(data, offsets[own], 0x20) if len(own) else data
        bounds = np.append(at, len(spaced))
        raw = spaced.tobytes()
        begins = cuts(spaced, bounds)
        ends = np.append(begins[1:], len(spaced))
        text = np.searchsorted(at, begins, "right") - 1
        m = len(own)
        n_a, n_b, n_groups, bad = (np.zeros(m, np.int64) for _ in range(4))
        digests, pairs = [hashlib.sha256() for _ in range(m)], [[] for _ in range(m)]
        for j in range(0, len(begins), step):
            if len(self.groups) > self.most:
                self.shrink()
            t = text[j : j + step]
            place = self.places(raw, begins[j : j + step], ends[j : j + step])
            heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            size = self.first[place + 1] - self.first[place]
            for total, v in ((n_a, self.n_a[place]), (n_b, self.n_b[place]), (n_groups, size), (bad, ~self.good[place])):
                total[t[heads]] += np.add.reduceat(v.astype(np.int64), heads)
            flat = self.pairs[np.arange(int(size.sum())) + np.repeat(self.first[place] - (np.cumsum(size) - size), size)]
            edge = np.append(0, np.cumsum(size))
            for h, stop in zip(heads.tolist(), [*heads[1:].tolist(), len(t)], strict=True):
                d = int(t[h])
                digests[d].update((b";" if begins[j + h] > at[d] else b"") + b";".join([self.groups[p] for p in place[h:stop].tolist()]))
                pairs[d].append(np.unique(flat[edge[h] : edge[stop]], return_counts=True))
        counts = np.zeros((3, n), np.int64)
        sha = [""] * n
        ids, times = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        for d, r in enumerate(own.tolist()):
            if bad[d]:
                continue
            counts[:, r] = n_a[d], n_b[d], n_groups[d]
            sha[r] = digests[d].hexdigest()
            found, inverse = np.unique(np.concatenate([p[0] for p in pairs[d]]), return_inverse=True)
            ids[r], times[r] = found, np.bincount(inverse, np.concatenate([p[1] for p in pairs[d]])).astype(np.int64)
        return counts, sha, ids, times


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs (a * 32768 + b, distinct and ascending), times (links of each pair)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            aligner = Aligner.shared(a_path, b_path)
            data, offsets = utf8_column(batch.column(1))
            nulls = np.asarray(batch.column(1).is_null())
            for i, j in row_slices(offsets, max_bytes):
                counts, sha, ids, times = aligner.take(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], nulls[i:j])
                lens = np.array([len(x) for x in ids])
                pairs, n = ragged(np.concatenate(ids), lens, pa.int32()), ragged(np.concatenate(times), lens, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, counts), pa.array(sha), pairs, n], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
            release()

    return source.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: links of each pair of ids over all texts; a task's own are summed by DuckDB before they are shuffled."""

    def run(batches):
        import duckdb

        db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        db.execute("create table held (pair integer, n bigint)")
        for batch in batches:
            db.register("t", pa.table({"pair": batch.column(0).flatten(), "n": batch.column(1).flatten()}))
            db.execute("create or replace table held as select pair, sum(n)::bigint as n from (select * from held union all select * from t) group by pair")
            db.unregister("t")
        yield from db.sql("select pair, n from held").to_arrow_table().to_batches()

    return found.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 22) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are those of a blank and the whole text, by a byte-level BPE (A) and a sentencepiece model (B). Null and empty texts,
    and such whose tokens spell something else (B knows U+2581 as a blank), have none: zeros and an empty digest. A link
    is a pair of tokens that end together, so the last of a group's; of pairs of a B id that are equally frequent all
    are best. Repeated rows each count. A text of any length is aligned whole, in steps of bounded memory. Other columns
    are ignored; an empty table gives no rows.
    """
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    a, b = ByteLevel(a_path), Pieces(b_path)
    if not b.can_cut or len(b.bytes) > 1 << 15 or len(a.bytes) > 1 << 16:
        raise ValueError("B's pieces hold line ends or inner blanks, or a vocabulary is too large")
    if linkable(a.bytes, b.bytes) > most:
        raise ValueError("the vocabularies have too many pairs that may end together")
    found = written(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = written(pair_counts(found), "pairs").toArrow().sort_by("pair")  # as many rows as linkable() says, at most
    pair, n = counts["pair"].to_numpy().astype(np.int64), counts["n"].to_numpy()
    highest = np.zeros(1 << 15, np.int64)
    np.maximum.at(highest, pair & 32767, n)
    sent = docs.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair & 32767]))

    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            pairs, times = batch.column(5), batch.column(6)
            at, times_ = np.searchsorted(pair, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
            edge = np.append(0, np.cumsum(pairs.value_lengths().to_numpy()))
            sums = []
            for v in (times_ * best[at], times_ * n[at]):
                total = np.append(0, np.cumsum(v))
                sums.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
            c = batch.columns
            yield pa.RecordBatch.from_arrays([*c[:4], c[3], *sums, c[4]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
