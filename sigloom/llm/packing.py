"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents.

A document is cut into full pieces of the sequence length and a remainder. Full pieces are sequences of their
own; remainders are packed, whole, inside groups of bounded expected size that a hash deals at random.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, narrow, stored
from sigloom.llm.textops import buffers, is_space, lowered

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 4096
SEED = 23
_CHUNK = 1 << 20
_KEPT_WORDS = 800_000
_BATCH = 1000
_PUNCTUATION = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: a word that ends in a letter (a-z or U+00C0 to U+00FF) and then ASCII punctuation other than an apostrophe
_ENDING = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)$", re.DOTALL)


def plain_lowered(data: np.ndarray) -> bytes:
    """Bytes with the words of ASCII and the letters U+00C0 to U+00FF made lower case, as the tokenizer would.

    All other words, and spellings of special tokens, stay for it: it composes letters before it lowers them, so a capital in
    front of a combining mark must reach it as it is.
    """
    low = lowered(data)
    if not len(data):
        return b""
    wide = np.zeros(len(data), bool)  # second bytes of U+00C0 to U+00FF
    wide[1:] = data[:-1] == 0xC3
    capital = wide & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[capital] |= 0x20
    odd = (data >= 128) & ~wide & (data != 0xC3)
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    if not odd.any():
        return low.tobytes()
    word = np.cumsum(is_space(data), dtype=np.int32)
    skip = np.zeros(int(word[-1]) + 1, bool)
    skip[word[odd]] = True
    return np.where(skip[word], data, low).tobytes()


class Encoder:
    """Token ids of texts, word by word.

    The vocabulary's tokens never cross white space, so a word's ids do not depend on its neighbours. Neither do they cross from a
    letter to the punctuation behind it: a word has one or two parts, and every part is encoded once per worker. Parts are
    encoded many at a time, with a digit of its own between them. When the cache holds more than ``_KEPT_WORDS`` words, those seen
    in one chunk only are forgotten, and all if the others are more than half of them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.border,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self._empty()

    def _empty(self) -> None:
        self.words, self.parts = {}, {}
        self.first, self.second, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        often = self.seen > 1
        if 2 * often.sum() > _KEPT_WORDS:
            self._empty()
            return
        kept = list(itertools.compress(self.words, often.tolist()))
        self.words = dict(zip(kept, range(len(kept))))
        used = np.zeros(len(self.parts), bool)
        first, second = self.first[often], self.second[often]
        used[first] = used[second[second >= 0]] = True
        number = np.cumsum(used) - 1
        names = list(itertools.compress(self.parts, used.tolist()))
        self.parts = dict(zip(names, range(len(names))))
        self.first, self.second, self.seen = number[first], np.where(second >= 0, number[second], -1), np.ones(len(kept), np.int64)
        starts, lengths = self.starts[used], self.lengths[used]
        begin = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(starts - begin, lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths = begin, lengths

    def chunk(self, data: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all texts in ``data`` in a row, and the number of ids of every text; ``borders`` are the texts' n + 1 offsets."""
        if len(self.words) > _KEPT_WORDS:
            self._forget()
        inside = ~is_space(np.frombuffer(data, np.uint8))
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        own = borders[:-1][borders[:-1] < len(data)]
        begin[own] = inside[own]
        starts = np.flatnonzero(begin)
        spans = np.append(starts, len(data)).astype(np.int32)  # every word with the white space behind it
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(spans), pa.py_buffer(data)]).dictionary_encode()
        words, known = self.words, len(self.words)
        number = np.array([words.setdefault(w.rstrip(), len(words)) for w in column.dictionary.to_pylist()], np.int64)
        if len(self.words) > known:
            self._learn(list(itertools.islice(self.words, known, None)))
        self.seen[number] += 1
        at = number[column.indices.to_numpy()]
        two = np.stack((self.first[at], self.second[at]), 1)
        part = two.ravel()
        counts = np.where(part >= 0, self.lengths[part], 0)
        first = np.cumsum(counts) - counts
        out = self.ids[np.repeat(self.starts[part] - first, counts) + np.arange(counts.sum())]
        upto = np.append(first, len(out))
        return out, np.diff(upto[2 * np.searchsorted(starts, borders)])

    def _learn(self, words: list[bytes]) -> None:
        """Take in new words: their parts, and the ids of parts not seen before."""
        parts, known, first, second = self.parts, len(self.parts), [], []
        for word in words:
            if word[-1] in _PUNCTUATION and (found := _ENDING.match(word)) and b"<|" not in word:
                stem, end = found.groups()
                first.append(parts.setdefault(stem, len(parts)))
                second.append(parts.setdefault(end, len(parts)))
            else:
                first.append(parts.setdefault(word, len(parts)))
                second.append(-1)
        self.first, self.second = np.append(self.first, np.array(first, np.int64)), np.append(self.second, np.array(second, np.int64))
        self.seen = np.append(self.seen, np.zeros(len(words), np.int64))
        fresh = list(itertools.islice(self.parts, known, None))
        ids, lengths = self._encoded(fresh)
        begin = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids, self.starts, self.lengths = np.append(self.ids, ids), np.append(self.starts, begin), np.append(self.lengths, lengths)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and their numbers per part. A part with the digit between parts is encoded alone."""
        lengths = np.zeros(len(parts), np.int64)
        alone = [i for i, p in enumerate(parts) if b"0" in p or b"<|" in p]
        apart = set(alone)
        rest = [i for i in range(len(parts)) if i not in apart] if alone else list(range(len(parts)))
        batches = [rest[i : i + _BATCH] for i in range(0, len(rest), _BATCH)]
        texts = [b" 0 ".join([parts[i] for i in batch]).decode() + " 0" for batch in batches]
        made = []
        for batch, found in zip(batches, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            border = ids == self.border
            ends = np.flatnonzero(border) - np.arange(len(batch))  # ids before every border, borders left out
            lengths[batch] = np.diff(ends, prepend=0)
            made.append(ids[~border])
        for i, found in zip(alone, self.tokenizer.encode_batch_fast([parts[i].decode() for i in alone], add_special_tokens=False)):
            made.append(np.array(found.ids, np.uint32))
            lengths[i] = len(made[-1])
        if not made:
            return np.zeros(0, np.uint32), lengths
        flat, order = np.concatenate(made), np.array(rest + alone, np.int64)
        if not alone:
            return flat, lengths
        taken = lengths[order]
        starts = np.empty(len(parts), np.int64)
        starts[order] = np.cumsum(taken) - taken
        before = np.cumsum(lengths) - lengths
        return flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())], lengths

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a column, the end id last."""
        data, at = buffers(column)
        n, row = len(at) - 1, 0
        while row < n:
            if at[row + 1] - at[row] > _CHUNK:
                yield np.append(self._long(data, int(at[row]), int(at[row + 1])), np.uint32(END_ID))
                row += 1
                continue
            stop = max(row + 1, int(np.searchsorted(at, at[row] + _CHUNK, "right")) - 1)
            raw, own = plain_lowered(data[at[row] : at[stop]]), at[row : stop + 1] - at[row]
            ids, counts = self.chunk(raw, own)
            begin = 0
            for end in np.cumsum(counts).tolist():
                yield np.append(ids[begin:end], np.uint32(END_ID))
                begin = end
            row = stop

    def _long(self, data: np.ndarray, start: int, end: int) -> np.ndarray:
        parts = []
        while start < end:
            to = min(end, start + _CHUNK)
            while to < end:
                spaces = np.flatnonzero(is_space(data[start:to]))
                if len(spaces):
                    to = start + int(spaces[-1]) + 1
                    break
                to = min(end, to + _CHUNK)
            parts.append(self.chunk(plain_lowered(data[start:to]), np.array([0, to - start]))[0])
            start = to
        return np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: doc_id, row, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        for batch in batches:
            doc_ids, rows = batch.column("doc_id"), batch.column("row")
            at, found = [], []
            for i, ids in enumerate(encoder(tokenizer).texts(batch.column("text"))):
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    at.append(i)
                    found.append((start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
            took = pa.array(at, pa.int64())
            numbers = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(took), rows.take(took), *(pa.array(numbers[:, k]) for k in range(4))],
                ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return narrow(docs).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, taken from the longest; equal lengths keep their order.

    Leaves of a complete binary tree are the free capacities of the bins, inner nodes the larger of both
    children; the first bin that still has room is found from the root down.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length()) if n else 1
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= length
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id stays null; repeated rows are documents of their own and are packed
    each; an empty table gives no rows. The number of groups follows the number of pieces, so that a group has about
    ``group_pieces`` of them whatever one document or source contributes.
    """
    cut = stored(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")  # texts are encoded once
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "row", "start", F.lit(SEED)), F.lit(groups)))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "row"], kind="stable", na_position="last")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["group"].to_numpy() << 32) + bins, offset=offsets)[_COLUMNS]

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("group").applyInPandas(fill, schema)


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = [Query("op7_packing", op7_packing)]
