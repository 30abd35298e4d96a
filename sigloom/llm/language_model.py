"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and scored from memory-mapped arrays.

Counting: words, then pairs of word numbers, are counted inside every task and merged shard by shard. Each shard is
written as sorted arrays into the shared folder: word hashes (a word's number is its place in them), pair keys with
counts, and per word its continuations and the statistics of the pairs it begins. Workers map these files
and look up sorted queries; nothing of the model passes through the driver but counts of counts and shard sizes.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, crc_bucket, documents, narrow, scratch
from sigloom.llm.textops import Words, mix, small

END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_HELD = 2_000_000
_ESCAPE = 255
_MOST_WORDS = 2**32 - 1


def local_path(uri: str) -> str:
    """Path of the shared folder as the workers' file system mounts it; maps need files, so other stores are refused."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays need a mounted shared folder, not {uri}")
    return parsed.path


def save(path: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step: a repeated task replaces it by the same bytes.

    Attempts of one task on several hosts may run at once, so each writes a file of its own name first.
    """
    part = f"{path}.{uuid4().hex}.part.npy"
    np.save(part, array)
    os.replace(part, path)


def load(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def narrowest(values: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit, in 64 otherwise."""
    return values.astype(np.uint32 if values.max(initial=0) <= np.iinfo(np.uint32).max else np.uint64)


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    """Counts written by ``narrowest`` for ``rows`` words, four to a word or one; the number of bytes tells their size."""
    per_row = len(raw) // rows
    size, columns = {4: (4, 1), 8: (8, 1), 16: (4, 4), 32: (8, 4)}[per_row]
    return np.frombuffer(raw, f"<u{size}").reshape(rows, columns).astype(np.int64)


def spread(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a 64-bit hash by its upper half: shards are ranges in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Counter:
    """Counts of 64-bit keys; gives them up, sorted and summed, whenever it holds too many."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        self.keys.append(keys)
        self.held += len(keys)
        return self.held > _HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(np.concatenate(self.keys), return_counts=True) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.held = [], 0
        return keys, counts


def packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard with its keys (kept in their order) and counts as bytes."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.uint32)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(shard.astype(np.int64))) + 1, [len(shard)])) if len(shard) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[cut[:-1]].astype(np.int64) if len(shard) else [], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
        ],
        ["shard", "keys", "counts"],
    )


PACKED = "shard bigint, keys binary, counts binary"


def merged(parts: pd.DataFrame, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one shard's parts in order, and their summed counts."""
    keys = np.concatenate([np.frombuffer(x, dtype) for x in parts["keys"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in parts["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, every row closed by the end token, and the rows' offsets."""
    counts = words.counts()
    ends = np.cumsum(counts)
    return np.insert(words.hashes, ends, END), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


@dataclass
class Model:
    """Where the arrays lie and the few numbers that all workers need."""

    folder: str
    shards: int
    word_starts: np.ndarray  # first number of every shard of words
    n_tokens: int
    n_words: int
    hot: np.ndarray  # words whose pairs are spread over all shards
    ranges: int = 0
    span: int = 1  # word numbers per range
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    n_pairs: int = 0
    low_rest: float = 1.0

    def __post_init__(self):
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state):
        self.__dict__.update(state, _open={})

    def array(self, name: str) -> np.ndarray:
        if name not in self._open:
            self._open[name] = load(f"{self.folder}/{name}.npy")
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of every word, -1 for unknown ones."""
        values, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(values), -1, np.int64)
        shard = spread(values, self.shards).astype(np.int64)
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(cut)):
            known = self.array(f"words-{k}") if self.word_starts[k + 1] > self.word_starts[k] else np.zeros(0, np.uint64)
            if not len(known):
                continue
            own = values[cut[k] : cut[k + 1]]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out[cut[k] : cut[k + 1]] = np.where(known[at] == own, at + self.word_starts[k], -1)
        return out[back]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training count of every word number."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.word_starts, numbers, "right") - 1
        for k in np.unique(shard[numbers >= 0]):
            own = np.flatnonzero((shard == k) & (numbers >= 0))
            out[own] = self.array(f"counts-{k}")[numbers[own] - self.word_starts[k]]
        return out

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        """Shard of pair keys: by their first word, for hot first words by both."""
        first = keys >> np.uint64(32)
        by = np.where(np.isin(first, self.hot), keys, first)
        return spread(mix(by + np.uint64(1)), self.shards)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        values, back = np.unique(keys, return_inverse=True)
        shard = self.pair_shard(values).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        out = np.zeros(len(values), np.int64)
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(cut)):
            if not os.path.exists(f"{self.folder}/pairs-{k}.npy"):
                continue
            known, few = self.array(f"pairs-{k}"), self.array(f"times-{k}")
            at = order[cut[k] : cut[k + 1]]
            place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
            found = known[place] == values[at]
            n = np.where(found, few[place], 0).astype(np.int64)
            big = np.flatnonzero(n == _ESCAPE)
            if len(big):
                n[big] = self.array(f"often-{k}")[np.searchsorted(self.array(f"places-{k}"), place[big])]
            out[at] = n
        return out[back]

    def statistics(self, numbers: np.ndarray) -> np.ndarray:
        """Per word number: continuations; pairs it begins: total, and how many occur once, twice, more often."""
        out = np.zeros((len(numbers), 5), np.int64)
        if not self.n_pairs:
            return out
        where = np.where(numbers >= 0, numbers // self.span, -1)
        for k in np.unique(where[where >= 0]):
            own = np.flatnonzero(where == k)
            out[own] = self.array(f"statistics-{k}")[numbers[own] - k * self.span]
        return out


def _unigrams(train: DataFrame, folder: str, shards: int) -> Model:
    """Count words and write every shard's hashes and counts."""

    def count(batches):
        held = Counter()
        for batch in small(batches):
            if held.add(tokens_of(Words(batch.column("text"), lower=True))[0]):
                keys, counts = held.take()
                yield packed(spread(keys, shards), keys, counts)
        keys, counts = held.take()
        yield packed(spread(keys, shards), keys, counts)

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(parts)
        shard = int(parts["shard"].iloc[0])
        save(f"{folder}/words-{shard}.npy", keys)
        save(f"{folder}/counts-{shard}.npy", counts)
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    sizes = train.mapInArrow(count, PACKED).groupBy("shard").applyInPandas(merge, "shard bigint, words bigint, tokens bigint").collect()
    words = np.zeros(shards + 1, np.int64)
    for row in sizes:
        words[row["shard"] + 1] = row["words"]
    model = Model(folder, shards, np.cumsum(words), sum(r["tokens"] for r in sizes), int(words.sum()), np.zeros(0, np.uint64))
    # at most 2 * shards words can hold more than that share of all tokens
    limit = max(1, model.n_tokens // (2 * shards))
    spark = train.sparkSession

    def hot(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                if model.word_starts[k + 1] > model.word_starts[k]:
                    often = np.flatnonzero(model.array(f"counts-{k}") > limit) + model.word_starts[k]
                    yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64())], ["word"])

    found = [r["word"] for r in spark.range(shards, numPartitions=min(shards, 16)).mapInArrow(hot, "word bigint").collect()]
    model.hot = np.array(sorted([*found, model.n_words]), np.uint64)  # the begin of a text opens one pair per document
    return model


def _pairs(train: DataFrame, model: Model) -> None:
    """Count pairs, write them by shard, then the statistics of every word; sets the model's discounts."""
    shards, folder = model.shards, model.folder
    if model.n_words >= _MOST_WORDS:
        raise ValueError(f"{model.n_words} distinct words: a pair key holds two numbers below {_MOST_WORDS}")
    model.span = max(1, -(-(model.n_words + 1) // shards))
    model.ranges = -(-(model.n_words + 1) // model.span)
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        own, held = shared.value, Counter()
        for batch in small(batches):
            hashes, at = tokens_of(Words(batch.column("text"), lower=True))
            numbers = own.numbers(hashes)
            before = np.concatenate(([0], numbers[:-1]))
            before[at[:-1]] = own.n_words  # the begin of a text
            if held.add((before.astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64)):
                keys, counts = held.take()
                yield packed(own.pair_shard(keys), keys, counts)
        keys, counts = held.take()
        yield packed(own.pair_shard(keys), keys, counts)

    def ranged(kind: int, shard: int, numbers: np.ndarray, values: np.ndarray) -> list[tuple]:
        """Values per word number, cut into ranges."""
        where = numbers // model.span
        cut = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(where)]))
        return [
            (kind, int(where[a]), numbers[a:b].astype(np.uint32).tobytes(), narrowest(values[a:b]).tobytes())
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) if b > a
        ]

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(parts)
        shard = int(parts["shard"].iloc[0])
        often = np.flatnonzero(counts >= _ESCAPE)
        save(f"{folder}/pairs-{shard}.npy", keys)
        save(f"{folder}/times-{shard}.npy", np.minimum(counts, _ESCAPE).astype(np.uint8))
        save(f"{folder}/places-{shard}.npy", often)
        save(f"{folder}/often-{shard}.npy", counts[often])
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        stats = np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
        follow, times = np.unique(second, return_counts=True)
        rows = ranged(0, shard, follow, times[:, None]) + ranged(1, shard, first[begin], stats)
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows.append((2, shard, np.array([len(keys), *of], np.int64).tobytes(), b""))
        return pd.DataFrame(rows, columns=["kind", "part", "numbers", "values"])

    def gather(parts: pd.DataFrame) -> pd.DataFrame:
        part = int(parts["part"].iloc[0])
        out = np.zeros((min(model.span, model.n_words + 1 - part * model.span), 5), np.int64)
        for kind, numbers, values in zip(parts["kind"], parts["numbers"], parts["values"]):
            at = np.frombuffer(numbers, np.uint32).astype(np.int64) - part * model.span
            columns = slice(0, 1) if kind == 0 else slice(1, 5)
            out[at, columns] += unpacked(values, len(at))
        save(f"{folder}/statistics-{part}.npy", narrowest(out))
        more = [int((out[:, 0] == k).sum()) for k in (1, 2, 3, 4)] + [int((out[:, 0] > 2).sum())]
        return pd.DataFrame({"part": [part], **{f"c{i + 1}": [n] for i, n in enumerate(more)}})

    counted = train.mapInArrow(count, PACKED).groupBy("shard").applyInPandas(merge, "kind int, part bigint, numbers binary, values binary")
    path = scratch(train.sparkSession, "pair-statistics")
    counted.write.parquet(path)
    made = train.sparkSession.read.parquet(path)
    totals = sum((np.frombuffer(r["numbers"], np.int64) for r in made.where("kind = 2").select("numbers").toLocalIterator()), np.zeros(5, np.int64))
    low = made.where("kind < 2").groupBy("part").applyInPandas(gather, "part bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint, c5 bigint").collect()
    of = [sum(r[f"c{k}"] for r in low) for k in (1, 2, 3, 4, 5)]
    model.n_pairs = int(totals[0])
    model.discounts, model.low_discounts = discounts(*totals[1:].tolist()), discounts(*of[:4])
    spared = sum(d * n for d, n in zip(model.low_discounts, (of[0], of[1], of[4])))
    model.low_rest = spared / model.n_pairs if model.n_pairs else 1.0


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more from the counts of counts; fixed ones where those are too few."""
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for d, k in zip(found, (1, 2, 3)))


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    steps = np.array([0.0, *by])
    return counts - steps[np.minimum(counts, 3)]


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Model of all texts of ``docs``. ``shards`` follows the number of the scan's partitions, so a shard holds about what a task counts."""
    texts = narrow(docs).select("text")
    shards = shards or max(16, 2 * texts.rdd.getNumPartitions())
    uri = scratch(docs.sparkSession, "language-model")
    folder = local_path(uri)
    os.makedirs(folder, exist_ok=True)
    model = _unigrams(texts, folder, shards)
    _pairs(texts, model)
    return model


def token_scores(model: Model, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: base score, model score (both log10 of a probability), and its training count."""
    numbers = model.numbers(hashes)
    counts = model.counts(numbers)
    base = np.log10((counts + 1) / (model.n_tokens + model.n_words + 1))
    before = np.concatenate(([0], numbers[:-1])) if len(numbers) else numbers
    before[at[:-1]] = model.n_words
    values, back = np.unique(np.concatenate((numbers, before)), return_inverse=True)
    stats = model.statistics(values)[back]
    own, context = stats[: len(numbers)], stats[len(numbers) :]
    low = discounted(own[:, 0], model.low_discounts) / max(model.n_pairs, 1) + model.low_rest / (model.n_words + 1)
    known = (numbers >= 0) & (context[:, 1] > 0)
    pairs = np.zeros(len(numbers), np.int64)
    keys = (before[known].astype(np.uint64) << np.uint64(32)) | numbers[known].astype(np.uint64)
    pairs[known] = model.pair_counts(keys)
    total = np.maximum(context[:, 1], 1)
    rest = (context[:, 2:] @ np.array(model.discounts)) / total
    high = discounted(pairs, model.discounts) / total + rest * low
    return base, np.log10(np.where(context[:, 1] > 0, high, low)), counts


def language_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document under ``model``.

    One row per input row. Null and empty texts are the end token alone. A null doc_id stays null; repeated rows get equal scores; an empty table
    gives no rows. An untrained model gives every token probability one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in small(batches):
            hashes, at = tokens_of(Words(batch.column("text"), lower=True))
            base, high, counts = token_scores(shared.value, hashes, at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at[:-1])),
                    pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(high, at[:-1])),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return narrow(docs).select("doc_id", "text").mapInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of all documents by a model of those outside one fold of the ids."""
    chosen = crc_bucket(docs["doc_id"].cast("bigint"), folds)
    model = train(docs.where(chosen != fold))
    scores = language_scores(docs, model)
    return scores.select(
        "doc_id", (crc_bucket(F.col("doc_id"), folds) == fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(documents(spark, sf_dir))


QUERIES = [Query("op2_language_model", op2_language_model)]
