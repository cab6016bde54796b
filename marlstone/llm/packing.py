"""Best-fit packing: each task packs its documents' tokens online into a fixed number of open sequences.

The open sequences are kept by their free space, with a bitset of the spaces in use; a piece goes to the fullest
sequence with room for it. When all places are taken and none fits, the fullest closes and an empty one opens. Pieces
arrive batch by batch, the longest of a batch first. No shuffle, and a repeated task gives the same sequences.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_type, bounded_batches, release
from .textbytes import NOT_SPACE, Spans, row_slices, utf8_column


class WordEncoder:
    """Token ids of texts by a tokenizer whose tokens never span white space, through a cache of encoded words.

    New words are encoded many in one call, a special token between them.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>", most: int = 2_000_000, at_once: int = 1 << 16):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark, self.most, self.at_once = separator, self.tokenizer.token_to_id(separator), most, at_once
        self._clear()

    def _clear(self):
        self.keys, self.at, self.len, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]):
        """Adds words; keys ascend. The tokenizer gets `at_once` characters a call, as what it makes of a text is many times as large."""
        ids, at, lens, size = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), len(self.ids)
        plain, odd = [k for k, w in enumerate(words) if self.separator not in w], [k for k, w in enumerate(words) if self.separator in w]
        chars = np.cumsum([len(words[k]) + len(self.separator) for k in plain])
        for some in np.split(np.array(plain, np.int64), np.flatnonzero(np.diff(chars // self.at_once)) + 1):
            joined = "".join(words[k] + self.separator for k in some.tolist())
            flat = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(flat == self.mark)[: len(some)]
            begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
            at[some], lens[some] = size + begins, ends - begins
            ids.append(flat)
            size += len(flat)
        for k in odd:
            own = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
            at[k], lens[k] = size, len(own)
            ids.append(own)
            size += len(own)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.len = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.len, where, lens)
        self.ids = np.concatenate((self.ids, *ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and each text's number of them."""
        spans = Spans(data, offsets, NOT_SPACE)
        keys, where, back = np.unique(spans.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(spans.starts[where[new]].tolist(), spans.ends[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        word_at, word_len = self.at[at][back], self.len[at][back]
        total = np.concatenate(([0], np.cumsum(word_len)))
        flat = self.ids[np.arange(total[-1]) + np.repeat(word_at - total[:-1], word_len)]
        return flat, total[spans.first[1:]] - total[spans.first[:-1]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process, kept for its later tasks."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Bounded-space best fit: at most `places` open sequences of `size` tokens."""

    def __init__(self, size: int, places: int):
        self.size, self.places = size, places
        self.bits, self.stacks, self.open, self.made = 0, [[] for _ in range(size + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The sequence (numbered from 0) a piece goes to, and its offset there."""
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.places:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, space = self.made, self.size
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.stacks[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        number = self.stacks[space].pop()
        if not self.stacks[space]:
            self.bits &= ~(1 << space)
        return number


SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 2048, places: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its tokens and end_id; only one of over `size` tokens is cut. A null or empty text is the end alone;
    ids may be null or repeat, each row is packed on its own; other columns are ignored; an empty table gives no rows.
    A document wider than a batch of Arrow is never split by it: a batch holds whole texts. Of open sequences with the same
    free space the last one opened or filled to it takes the next piece.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"]
    schema = f"doc_id {kind.dataType.simpleString()}, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    id_type = arrow_type(kind.dataType)

    def run(batches):
        if tokenizer_path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        else:
            path = tokenizer_path
        coder, packer = encoder(path), Packer(size, places)
        task = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for i, j in row_slices(offsets, 1 << 22):
                # a quarter at a time, as the arrays of words are many times as large as the text
                parts = [coder.encode(data[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a]) for a, b in row_slices(offsets[i : j + 1], 1 << 20)]
                flat, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                # the ends go in after each text's ids
                at = np.concatenate(([0], np.cumsum(counts + 1)))
                ids = np.full(at[-1], end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(j - i), counts)] = flat
                pieces = -(-(counts + 1) // size)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)))[:-1], pieces)
                start = piece * size
                length = np.minimum(size, (counts + 1)[doc] - start)
                begin = at[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], np.int64)
                place = np.zeros((len(doc), 2), np.int64)
                for k in np.argsort(-length, kind="stable").tolist():
                    place[k] = packer.put(int(length[k]))
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(doc)).cast(id_type), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(place[:, 0] + task), pa.array(place[:, 1])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(begin, length, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            release()

    return docs.mapInArrow(run, schema)
