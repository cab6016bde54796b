"""URL filters: rules and a block list held in a Bloom filter cascade, which is exact over the corpus's keys.

A key is a host suffix and a path prefix (``example.net/en/``); a url's keys are those of its host's suffixes with its
path's prefixes. Level 0 of the cascade encodes the listed keys; level 1 the keys of the corpus that are not listed and
pass level 0; level 2 the listed keys that pass level 1; and so on until none is left. So for every key of the corpus the
answer is exact, and urls are judged with no join. The universe is all keys of all urls. Filters are packed bits. They are
broadcast while they have `max_bytes` at most, level 1, which grows with the universe, counted in; beyond that the keys are
split by hash into shards, each with a cascade and a pass of its own, and a shard that comes out larger is split again.
Keys are told apart by 128 bits of hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_type, fresh, remove, written
from .textbytes import U, mix, range_hashes, utf8_column

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = U(0x8CB92BA72F3D8DD7)
MIRROR = np.arange(256, dtype=np.uint8)[::-1].copy()


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, labels: int, depth: int) -> Column:
    """The url's keys of at most `labels` host labels and `depth` slashes in the path; none without a host or path."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    pieces = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(pieces) - 1, F.lit(depth))), lambda k: F.concat(F.array_join(F.slice(pieces, F.lit(1), k), "/"), F.lit("/")))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when((host != "") & path.startswith("/"), both).otherwise(F.array().cast("array<string>"))


def hash_keys(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key, of its bytes and of these mirrored."""
    data, offsets = utf8_column(keys)
    return range_hashes(data, offsets[:-1], offsets[1:]), range_hashes(data, offsets[:-1], offsets[1:], MIRROR)


def positions(h: tuple[np.ndarray, np.ndarray], level: int, size: int, k: int) -> np.ndarray:
    """k bit positions of each hash in the filter of a level."""
    a = mix(h[0] + U((level + 1) * int(_S) % (1 << 64)))
    b = mix(h[1] ^ a) | U(1)
    return ((a[None, :] + np.arange(k, dtype=np.uint64)[:, None] * b[None, :]) % U(size)).astype(np.int64)


class TooLarge(Exception):
    """The filters would exceed their bound."""


@dataclass
class Cascade:
    levels: list  # packed bits, low ones first
    k: int

    def __contains__(self, key: str) -> bool:
        return bool(self.listed(hash_keys(pa.array([key])))[0])

    def listed(self, h: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(h[0]), bool)
        todo = np.arange(len(out))
        for level in range(len(self.levels)):
            todo = todo[self.passes((h[0][todo], h[1][todo]), level)]
            out[todo] = level % 2 == 0
        # those that stopped at a level keep the answer of the one before
        return out

    def passes(self, h: tuple[np.ndarray, np.ndarray], level: int) -> np.ndarray:
        if not len(h[0]):
            return np.zeros(0, bool)
        bits = self.levels[level]
        at = positions(h, level, len(bits) * 8, self.k)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)

    def bytes(self) -> int:
        return sum(len(b) for b in self.levels)


HASHED = "h long, g long, listed boolean"


def _pair(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))


def build(universe: DataFrame, bits_per_key: int = 12, k: int = 6, max_levels: int = 64, max_bytes: int | None = None) -> Cascade:
    """The cascade of universe(key, listed). Each level is one pass; tasks send set bits, 64 to a row, not keys.

    A level that would take it beyond max_bytes raises TooLarge before it is built.
    """
    spark = universe.sparkSession

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hash_keys(batch.column(0))), batch.column(1)], names=["h", "g", "listed"])

    left = written(universe.select("key", "listed").mapInArrow(hashed, HASHED).distinct(), "keys")
    cascade = Cascade([], k)
    for level in range(max_levels):
        side = left.where(F.col("listed") == (level % 2 == 0))
        n = side.count()
        if not n:
            remove(left)
            return cascade
        size = max(64, -(-n * bits_per_key // 64) * 64)
        if max_bytes is not None and cascade.bytes() + size // 8 > max(max_bytes, 64):
            remove(left)
            raise TooLarge

        def bits(batches, level=level, size=size):
            for batch in batches:
                at = np.unique(positions(_pair(batch), level, size, k))
                word, start = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(U(1) << (at & 63).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

        table = side.select("h", "g").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(size // 64, np.uint64)
        words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        cascade.levels.append(words.view(np.uint8))
        handle = spark.sparkContext.broadcast(cascade)

        def still(batches, level=level, handle=handle):
            for batch in batches:
                yield batch.filter(pa.array(handle.value.passes(_pair(batch), level) | (np.asarray(batch.column(2)) == (level % 2 == 0))))

        kept = written(left.mapInArrow(still, HASHED), "keys")
        handle.destroy()
        remove(left)
        left = kept
    raise ValueError("two keys of the corpus have one hash of 128 bits")


def judge(pages: DataFrame, rules: dict[str, str], blocked: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bytes: int = 64 << 20, bits_per_key: int = 12) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict.

    rules maps keys such as ``net/`` to block or allow; blocked(key) is the block list. The longest rule that fits wins;
    without a rule, a url with a key on the block list is blocked, any other allowed. A key is a host, a slash and, if more
    follows, a path that ends in a slash; any other is refused. A null url, or one without ``://``, has an empty host and
    path and is allowed; a url of any length is looked up whole; repeated rows are judged alike, and repeated keys count
    once; rules of one length can't fit one url; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = blocked.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    slashes, dots = F.length("key") - F.length(F.replace("key", F.lit("/"))), F.length(F.substring_index("key", "/", 1)) - F.length(F.replace(F.substring_index("key", "/", 1), F.lit("."))) + 1
    odd = listed.where(~F.col("key").rlike(r"^[^/]+/(.*/)?$")).first()
    if odd or not all(r.endswith("/") and not r.startswith("/") for r in rules):
        raise ValueError(f"a key is host/ or host/path/, not {odd[0] if odd else [r for r in rules if not r.endswith('/')]}")
    depth, labels = listed.agg(F.coalesce(F.max(slashes), F.lit(0)), F.coalesce(F.max(dots), F.lit(0))).first()
    depth = max([depth, *(r.count("/") for r in rules)], default=1)
    labels = max([labels, *(r.split("/")[0].count(".") + 1 for r in rules)], default=1)
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, depth))
    universe = urls.select(F.explode("keys").alias("key")).distinct()
    ruled = spark.createDataFrame([(r,) for r in rules] or [], "key string")
    listed_keys = listed.union(ruled).distinct().withColumn("listed", F.lit(True))
    universe = written(universe.join(listed_keys, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    n, every = universe.agg(F.count_if("listed"), F.count("*")).first()
    guess = (2 * n + 0.01 * every) * bits_per_key / 8  # a hundredth of the universe passes level 0 at most
    todo = [(s, shards) for shards in [max(1, -(-int(guess) // max_bytes))] for s in range(shards)]
    found = urls.withColumn("hits", F.array().cast("array<string>"))
    while todo:
        s, shards = todo.pop()
        part = lambda key, s=s, shards=shards: F.pmod(F.xxhash64(key), F.lit(shards)) == s
        try:
            cascade = build(universe.where(part("key")) if shards > 1 else universe, bits_per_key, max_bytes=max_bytes if shards < 1 << 20 else None)
        except TooLarge:
            todo += [(s, 2 * shards), (s + shards, 2 * shards)]
            continue
        only = shards == 1
        tested = _hits(found if only else found.withColumn("keys", F.filter("keys", part)), cascade)
        found = tested.withColumn("hits", F.concat("hits", "new")).drop("new")
        if not only:
            found = written(found.drop("keys"), "urls")
            found = found.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, depth))
    remove(universe)
    names = F.array(*[F.lit(r) for r in sorted(rules, key=lambda r: (-len(r), r))]) if rules else F.array().cast("array<string>")
    rule = F.get(F.filter(names, lambda r: F.array_contains("hits", r)), F.lit(0))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.when(F.size("hits") > 0, F.lit("block")).otherwise("allow"))
    return found.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _hits(urls: DataFrame, cascade: Cascade) -> DataFrame:
    """urls with `new`: those of their keys that the cascade lists."""
    handle = urls.sparkSession.sparkContext.broadcast(cascade)
    keys = urls.columns.index("keys")
    schema = T.StructType([*urls.schema.fields, T.StructField(fresh("new", urls.columns), T.ArrayType(T.StringType()))])
    names, kind = [f.name for f in schema.fields], arrow_type(schema.fields[-1].dataType)

    def run(batches):
        for batch in batches:
            lists = batch.column(keys)
            flat = lists.flatten()
            yes = handle.value.listed(hash_keys(flat))
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            counts = np.bincount(row[yes], minlength=len(lists))
            new = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat.filter(pa.array(yes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, new.cast(kind)], names=names)

    return urls.mapInArrow(run, schema)
