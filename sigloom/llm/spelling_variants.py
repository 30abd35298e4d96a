"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

The vocabulary is sharded by word length. Bits of blocked Bloom filters, one per shard, are merged in Spark and sent to the
workers; a task generates the edits of its words, probes the filter of the length they would have, and gives out only the
positives, which an exact join with the vocabulary then confirms. Filters are sized by the vocabulary: one that would pass a
fixed size is probed in several rounds, each with the filters of one part of all words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, stored
from sigloom.llm.textops import cached_powers, mix

_HELD = 400_000
_PIECE = 8 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PROBES = 6  # bits of a word in its block of 512
_EDITS = 1 << 21  # edits probed at a time


@dataclass(frozen=True)
class Settings:
    """``min_chars``, ``min_count``: of a word of the vocabulary; ``ratio``: how much more frequent a form is; ``damage``: see ``word_counts``.

    ``bits``: filter bits per word, rounded up to a power of two of blocks (words of the last shard, which any longer word shares, get
    eight times as many); ``round_bytes``: most that all filters of a round may take; ``last_shard``: its length.
    """

    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    damage: int = 31
    bits: int = 16
    round_bytes: int = 16 << 20
    last_shard: int = 48


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of some megabytes, cut at spaces."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + _PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def _text_words(doc_id, raw: bytes, least: int, damage: int) -> Iterator[tuple[str, int]]:
    found: Counter = Counter()
    for piece in _pieces(raw.lower().decode()):  # bytes lower A-Z only
        found.update(w for w in _RUN.findall(piece) if len(w) >= least)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % damage == 0:
            cut = h % len(word)
            word = word[:cut] + word[cut + 1 :]
            if len(word) < least:
                continue
        yield word, n


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """``word, n``: the vocabulary, after one letter was deleted from the runs that their document's id and checksum pick."""
    least, damage = settings.min_chars, settings.damage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                for word, n in _text_words(doc_id, text.as_py(), least, damage):
                    held[word] += n
                if len(held) > _HELD:
                    yield emit()
                    held.clear()
        yield emit()

    texts = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= settings.min_count)


@dataclass(frozen=True)
class Filters:
    """Shape of the filters: of every shard its number of blocks (a power of two), and where its 64-bit words start."""

    shards: dict[int, tuple[int, int]]
    last: int
    parts: int

    @staticmethod
    def sized(counts: dict[int, int], settings: Settings) -> Filters:
        shards, at = {}, 0
        each = {s: settings.bits * (8 if s == settings.last_shard else 1) for s in counts}
        total = sum(max(512, 2 * n * each[s]) for s, n in counts.items()) // 8
        parts = 1
        while parts * settings.round_bytes < total:
            parts *= 2
        for shard, n in sorted(counts.items()):
            blocks = 1 << max(0, (-(-n * each[shard] // (512 * parts)) - 1).bit_length())
            shards[shard] = (blocks, at)
            at += 8 * blocks
        return Filters(shards, settings.last_shard, parts)

    def words(self) -> int:
        return sum(8 * blocks for blocks, _ in self.shards.values())

    def places(self, hashes: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """First 64-bit word of the block of every hash, and a second hash that picks its bits."""
        blocks, at = self.shards[shard]
        return at + 8 * (hashes & np.uint64(blocks - 1)).astype(np.int64), mix(hashes ^ np.uint64(0xA0761D6478BD642F))

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(40)) & np.uint64(self.parts - 1)


def _bit(picks: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word in the block, and bit in it, of a probe."""
    nine = (picks >> np.uint64(9 * probe)) & np.uint64(511)
    return (nine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (nine & np.uint64(63))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, and their letters as a matrix of codes under 256."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, _EDITS // int(length))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            letters = np.frombuffer("".join(words[r] for r in own).encode("latin-1"), np.uint8).reshape(len(own), length)
            yield own, letters


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    return cached_powers(_BASE, length), cached_powers(_BASE, 2, True)[1]


def _sums(letters: np.ndarray) -> np.ndarray:
    """Running sums of the letters' codes times powers of the base; the last one, mixed, is a word's hash."""
    sums = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(_LETTERS[letters] * _powers(letters.shape[1])[0], axis=1, out=sums[:, 1:])
    return sums


def _filter_rows(filters: Filters, part: int):
    """Words -> (chunk, 64-bit word, bits) of the filters of one part, combined within a batch; chunk -1 carries the letters seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters_seen = np.zeros(256, bool)
        for batch in batches:
            places, bits = [], []
            for _, letters in _by_length(batch.column("word").to_pylist()):
                letters_seen[letters] = True
                hashes = mix(_sums(letters)[:, -1])
                hashes = hashes[filters.part(hashes) == part]
                base, picks = filters.places(hashes, min(letters.shape[1], filters.last))
                for probe in range(_PROBES):
                    word, bit = _bit(picks, probe)
                    places.append(base + word)
                    bits.append(bit)
            if places:
                place, bit = np.concatenate(places), np.concatenate(bits)
                order = np.argsort(place, kind="stable")
                place, bit = place[order], bit[order]
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))[: len(place)]
                merged = np.bitwise_or.reduceat(bit, first) if len(place) else bit
                yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(merged.view(np.int64))], ["place", "bits"])
        seen = np.packbits(letters_seen, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-4, 0)), pa.array(seen)], ["place", "bits"])

    return run


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"places": [rows["place"].to_numpy(np.int64).tobytes()], "bits": [rows["bits"].to_numpy(np.int64).tobytes()]})


def filter_bits(vocabulary: DataFrame, filters: Filters, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters' 64-bit words (at most ``round_bytes`` of them) and the mask of letters that occur."""
    rows = vocabulary.select("word").mapInArrow(_filter_rows(filters, part), "place bigint, bits bigint")
    merged = rows.groupBy("place").agg(F.bit_or("bits").alias("bits"))
    chunks = merged.groupBy(F.shiftright("place", 13).alias("chunk")).applyInPandas(_packed, "places binary, bits binary")
    table, seen = np.zeros(filters.words(), np.uint64), np.zeros(4, np.int64)
    for row in chunks.toLocalIterator():
        place, bits = np.frombuffer(row["places"], np.int64), np.frombuffer(row["bits"], np.int64)
        own = place >= 0
        table[place[own]] = bits[own].view(np.uint64)
        seen[place[~own] + 4] = bits[~own]
    return table, np.unpackbits(seen.view(np.uint8), bitorder="little").astype(bool)


def _marked(hashes: np.ndarray, shard: int, filters: Filters, part: int, table: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter of their shard may hold."""
    at = np.flatnonzero(filters.part(hashes) == part) if filters.parts > 1 else np.arange(len(hashes))
    base, picks = filters.places(hashes[at], shard)
    for probe in range(_PROBES):
        word, bit = _bit(picks, probe)
        hit = np.flatnonzero(table[base + word] & bit)
        at, base, picks = at[hit], base[hit], picks[hit]
    return at


def _replaced(letters, sums, alphabet, length, probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, new letter) of the positives among replacements by a later letter; the other word finds the earlier ones."""
    n, powers = len(letters), _powers(length)[0]
    step = max(1, _EDITS // max(1, n * len(alphabet)))
    for at in range(0, length, step):
        old = letters[:, at : at + step]
        later = np.argwhere(alphabet[None, None, :] > old[:, :, None])
        row, place, new = later[:, 0], later[:, 1], alphabet[later[:, 2]]
        change = (_LETTERS[new] - _LETTERS[old[row, place]]) * powers[at + place]
        hit = probe(mix(sums[row, -1] + change))
        yield row[hit], at + place[hit], new[hit]


def _deleted(letters, sums, length, probe) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of the positives among deletions; of a run of equal letters only the first is tried."""
    first = np.ones(letters.shape, bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, place = np.nonzero(first)
    rest = (sums[row, -1] - sums[row, place + 1]) * _powers(length)[1]
    hit = probe(mix(sums[row, place] + rest))
    yield row[hit], place[hit]


def _positives(filters: Filters, part: int, sent, least: int):
    """(word, n) -> (word, n, other): edits that the filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value
        alphabet = np.flatnonzero(seen).astype(np.uint8)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for own, letters in _by_length(words):
                length, sums = letters.shape[1], _sums(letters)
                found = []
                for shorter in (0, 1):
                    shard = min(length - shorter, filters.last)
                    if length - shorter < least or shard not in filters.shards:
                        continue
                    probe = lambda hashes: _marked(hashes, shard, filters, part, table)  # noqa: E731, B023
                    if shorter:
                        for row, place in _deleted(letters, sums, length, probe):
                            found += [(r, words[r][:p] + words[r][p + 1 :]) for r, p in zip(own[row], place)]
                    else:
                        for row, place, new in _replaced(letters, sums, alphabet, length, probe):
                            found += [(r, words[r][:p] + chr(c) + words[r][p + 1 :]) for r, p, c in zip(own[row], place, new)]
                if found:
                    rows = [r for r, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[r] for r in rows]), pa.array(counts[rows]), pa.array([other for _, other in found])], ["word", "n", "other"]
                    )

    return run


def near_words(vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """``word, n, other, other_n``: every unordered pair of words one edit apart, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(settings.last_shard)).alias("shard")
    counts = {row["shard"]: row["count"] for row in vocabulary.groupBy(shard).count().collect()}  # a row per shard
    found = spark.createDataFrame([], "word string, n bigint, other string, other_n bigint")
    if not counts:
        return found
    filters = Filters.sized(counts, settings)
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    spread = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for part in range(filters.parts):
        sent = spark.sparkContext.broadcast(filter_bits(vocabulary, filters, part))
        edits = spread.mapInArrow(_positives(filters, part, sent, settings.min_chars), "word string, n bigint, other string")
        found = found.unionByName(stored(edits.join(known, "other"), "near-words"))
        sent.destroy()
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form; counts grow along forms, so the chains end.

    Every round doubles the links followed, until no word's root has a form itself.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stored(
            found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if found.where("moved").isEmpty():
            return found.drop("moved")
        found = found.drop("moved")


def spelling_variants(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Words of the corpus, each with the number of words one edit away, its form and the root its forms lead to.

    Columns ``word, form, root, n, n_near, form_n``. Null texts have no words; a null id counts as the empty text. Repeated rows
    count each; other columns are ignored. A form is the near word of largest ``n`` (ties: the smallest in code-point order) if it has
    at least ``ratio`` times the word's ``n``. An empty table gives an empty result.
    """
    settings = settings or Settings()
    vocabulary = stored(word_counts(docs, settings), "vocabulary")
    near = near_words(vocabulary, settings)
    ends = (("word", "other", "other_n"), ("other", "word", "n"))
    ways = F.array(*[F.struct(*[F.col(c).alias(name) for c, name in zip(end, ends[0])]) for end in ends])
    links = near.select(F.explode(ways).alias("way")).select("way.word", "way.other", "way.other_n")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    leads = links.groupBy("word").agg(F.count("*").alias("n_near"), best)
    led = F.when(-F.col("best.less") >= settings.ratio * F.col("n"), F.col("best"))
    words = vocabulary.join(leads, "word", "left").withColumn("best", led).select(
        "word", F.col("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-F.col("best.less")).alias("form_n")
    )
    words = stored(words, "word-forms")
    led_on = roots(words.where("form IS NOT NULL"))
    return words.join(led_on, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(b))),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    found AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)) AS b FROM found),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + xor(c % 256, x)])), 4294967295::BIGINT) AS h
        FROM bytes, crc),
    spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cuts AS MATERIALIZED (SELECT DISTINCT word, n, i, left(word, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM words, range(64) r(i) WHERE i < length(word)),
    shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = c.head || c.tail),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
        UNION ALL SELECT word, n, other, other_n FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter),
    best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS best FROM near GROUP BY word),
    forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.form END AS form,
        CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root, form AS next FROM forms
        UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES = [Query("op12_spelling_variants", _query, SQL)]
