"""Similarity join of word-shingle sets by prefix trees.

Every text becomes a set of shingle hashes under one global order: shingles estimated frequent come last. Sets that
reach the threshold share a shingle among their first n - ceil(t n) + 1 ones, so candidates meet there. They are confirmed
in prefix trees: sets sorted by the global order share the paths of common beginnings, a probe carries its
overlap along a path and leaves a subtree once even all remaining shingles could not reach the required overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, keep_rows, narrow, stored
from sigloom.llm.components import components
from sigloom.llm.sketch import Sketch, bit_table
from sigloom.llm.textops import Words, mix, rolling, small
from sigloom.operators.skew import salted_join

_LATE = np.uint64(1 << 63)
BLOCK = 128
_LETTERS = 6  # of a word and the space behind it, about


@dataclass(frozen=True)
class Settings:
    """Shingle width, threshold in percent, sketch shapes, and the count from which a shingle comes last.

    The sketches only spare work and set the order: results do not depend on them. Their sizes are the least ones: the corpus'
    grows to two cells a shingle, the candidates' to four, as far as ``Sketch.grown`` allows.
    """

    width: int = 5
    percent: int = 80
    corpus: Sketch = Sketch(rows=1, bits=28)
    candidates: Sketch = Sketch(rows=1, bits=25)
    frequent: int = 24


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Smallest intersection of sets of n and m that links them: 100 i >= percent (n + m - i)."""
    return -((-percent * (n + m)) // (100 + percent))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit shingle hashes of every row, in order, and their n + 1 offsets.

    Fewer words than ``width`` give the whole sequence as the one shingle; no word gives none.
    """
    words = Words(column, lower=True)
    n, rows, counts = len(words.hashes), words.rows(), words.counts()
    keys, owner = [], []
    if n >= width:
        whole = np.flatnonzero(rows[width - 1 :] == rows[: n - width + 1])
        keys.append(rolling(words.hashes, width)[whole])
        owner.append(rows[whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        keys.append(np.array([_sequence(words.hashes[words.offsets[i] : words.offsets[i + 1]]) for i in short], np.uint64))
        owner.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(words) + 1, np.int64)
    key, row = np.concatenate(keys) >> np.uint64(1), np.concatenate(owner)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[fresh], row[fresh]
    return key, np.searchsorted(row, np.arange(len(words) + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words; its length takes part, so it equals no other length's."""
    return rolling(np.concatenate(([np.uint64(len(hashes))], hashes)), len(hashes) + 1, 0xC2B2AE3D27D4EB4F)[0]


def signature(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digest of every set."""
    out = []
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(salt))))) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
    for s in sums:
        out.append(mix((s[offsets[1:]] - s[offsets[:-1]]) + np.diff(offsets).astype(np.uint64)))
    return [bytes(x) for x in np.stack(out, 1).astype(">u8").view("V16").ravel()]


class PrefixTree:
    """Ordered sets in a prefix tree, kept as the sorted list of sets and the lengths of common beginnings of neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0] * len(sets)
        for k in range(1, len(sets)):
            a, b = self.sets[k - 1], self.sets[k]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[k] = int(differ[0]) if len(differ) else m

    def links(self, probe: np.ndarray, percent: int, step: int = 64) -> list[int]:
        """Numbers of the sets linked with ``probe``, in a walk over the tree.

        ``path`` holds the probe's overlap after every shingle of the current path; the next set reuses it
        up to where both part. A walk stops where overlap plus the shorter remainder stays below the bound.
        """
        found, path, n = [], np.zeros(1, np.int64), len(probe)
        for k, tokens in enumerate(self.sets):
            m = len(tokens)
            path = path[: self.shared[k] + 1]
            need = int(least_overlap(n, m, percent))
            if need > min(n, m):
                continue
            while True:
                depth, overlap = len(path) - 1, int(path[-1])
                left = n - int(np.searchsorted(probe, tokens[depth - 1], "right")) if depth else n
                if overlap + min(m - depth, left) < need:
                    break  # sets below share this path: they start from the same depth and overlap
                if depth == m:
                    found.append(self.order[k])
                    break
                part = tokens[depth : depth + step]
                at = np.minimum(np.searchsorted(probe, part), n - 1)
                path = np.concatenate((path, overlap + np.cumsum(probe[at] == part)))
        return found


def _ordered(raw: bytes, late: np.ndarray, sketch: Sketch) -> np.ndarray:
    """A stored set in the global order: frequent shingles get a leading bit and so come last."""
    tokens = np.frombuffer(raw, np.uint64)
    return np.sort(np.where(sketch.marked(tokens, late), tokens | _LATE, tokens))


def candidate_sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """Every document: doc_id, row, n, sig (digest of its set); and ``tokens``, the set, if enough of it occurs twice.

    A set can only be linked with another text's if the threshold's share of it is estimated to occur in two documents.
    """
    letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    corpus = settings.corpus.grown(2 * letters // _LETTERS)
    seen = bit_table(texts.select("text"), lambda batch: shingles(batch.column("text"), settings.width)[0], corpus, 2)

    def run(batches):
        for batch in small(batches):
            tokens, at = shingles(batch.column("text"), settings.width)
            n = np.diff(at)
            sums = np.concatenate(([0], np.cumsum(corpus.marked(tokens, seen.value))))
            twice = sums[at[1:]] - sums[at[:-1]]
            can = (n > 0) & (100 * twice >= settings.percent * n)
            raw = [tokens[at[i] : at[i + 1]].tobytes() if ok else None for i, ok in enumerate(can.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(n - twice, pa.int64()),
                 pa.array(signature(tokens, at), pa.binary()), pa.array(raw, pa.binary())],
                ["doc_id", "row", "n", "loose", "sig", "tokens"],
            )

    schema = "doc_id bigint, row bigint, n bigint, loose bigint, sig binary, tokens binary"
    return stored(texts.mapInArrow(run, schema), "shingle-sets")


def prefixes(sets: DataFrame, settings: Settings, order: Sketch, shared_bits, late_bits) -> DataFrame:
    """First shingles of every candidate set that may occur in another: token, id, n, place, share (of loose shingles, in thousandths)."""

    def run(batches):
        for batch in batches:
            ids, loose = (batch.column(c).to_numpy() for c in ("id", "loose"))
            cells = []
            for i, raw in enumerate(batch.column("tokens").to_pylist()):
                tokens = _ordered(raw, late_bits.value, order)
                n = len(tokens)
                first = tokens[: n - -(-settings.percent * n // 100) + 1]
                place = np.flatnonzero(order.marked(first & ~_LATE, shared_bits.value))
                cells.append([first[place].view(np.int64), *(np.full(len(place), x) for x in (ids[i], n)), place, np.full(len(place), 1000 * loose[i] // n)])
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*cells)], ["token", "id", "n", "place", "share"])

    return sets.select("id", "tokens", "loose").mapInArrow(run, "token bigint, id bigint, n bigint, place bigint, share bigint")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings, order: Sketch, late_bits) -> DataFrame:
    """The linked ones of ``pairs`` (a, probe) of different sets: a, b.

    The sets to be compared with one probe are dealt into blocks of about ``BLOCK``, each one a prefix tree which the
    probe walks; a probe with very many candidates has as many blocks.
    """
    sizes = pairs.groupBy("probe").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks"))
    dealt = salted_join(pairs, sizes, ["probe"], ["a"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    own = sets.select(F.col("id").alias("a"), "tokens")
    members = dealt.select("a", "probe", "block").join(own, "a").select("probe", "block", "a", "tokens")
    probes = sizes.join(own.withColumnRenamed("a", "probe"), "probe").select(
        "probe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("probe").alias("a"), "tokens"
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        is_probe = group["a"] == group["probe"]
        if not is_probe.any() or is_probe.all():
            return pd.DataFrame({"a": [], "b": []})
        probe = _ordered(group["tokens"][is_probe].iloc[0], late_bits.value, order)
        rest = group[~is_probe]
        tree = PrefixTree([_ordered(raw, late_bits.value, order) for raw in rest["tokens"]])
        hits = tree.links(probe, settings.percent)
        return pd.DataFrame({"a": rest["a"].iloc[hits].to_numpy(), "b": group["probe"].iloc[0]})

    return members.unionByName(probes).groupBy("probe", "block").applyInPandas(walk, "a bigint, b bigint")


def open_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components (token, id, n, place, comp) that may be linked: a, probe."""
    x, y = entries.alias("x"), entries.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    # at their first common shingle, linked sets still pass this bound on what can follow; the later ones may fail it
    most = 1 + F.least(n - F.col("x.place") - 1, m - F.col("y.place") - 1)
    fits = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
        & (100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * most >= percent * (n + m))
    )
    return x.join(y, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("probe")).distinct()


def set_links(sets: DataFrame, settings: Settings) -> DataFrame:
    """Links between different candidate sets (id, tokens, loose) that connect all that are linked: a, b.

    First every set is compared with the most central set among those it shares most buckets with. Only pairs whose components
    still differ are then compared one by one, so a large group of similar sets never gives all its pairs.
    """
    kept = (sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // 8
    order = settings.candidates.grown(4 * kept)
    bits = bit_table(
        sets.select("tokens"), lambda batch: np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64),
        order, 2, settings.frequent, column="tokens",
    )
    shared_bits, late_bits = bits.level(0), bits.level(1)
    entries = stored(prefixes(sets, settings, order, shared_bits, late_bits), "prefixes")
    central = F.struct("share", "id", "n")
    buckets = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(central).alias("rep")).where("size > 1")
    buckets = buckets.select("token", F.col("rep.id").alias("probe"), F.col("rep.n").alias("m"))
    # most shingles of a prefix that pass the sketch are in no other prefix: only those of two are read again
    entries = stored(entries.select("token", "id", "n", "place").join(buckets, "token"), "shared-prefixes")
    near = (F.col("id") != F.col("probe")) & (100 * F.col("n") >= settings.percent * F.col("m")) & (100 * F.col("m") >= settings.percent * F.col("n"))
    shared = entries.where(near).groupBy("id", "probe").agg(F.count(F.lit(1)).alias("times"))
    best = shared.groupBy("id").agg(F.max(F.struct("times", "probe")).alias("best")).select(F.col("id").alias("a"), F.col("best.probe").alias("probe"))
    first = stored(confirmed(stored(best, "first-pairs"), sets, settings, order, late_bits), "first-links")
    comp = components(first)

    entries = entries.drop("probe", "m").join(comp.withColumnRenamed("node", "id"), "id", "left")
    entries = stored(entries.withColumn("comp", F.coalesce("comp", "id")), "open-prefixes")
    mixed = entries.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    rest = stored(entries.join(mixed, "token", "left_semi"), "mixed-prefixes")
    second = stored(confirmed(stored(open_pairs(rest, settings.percent), "second-pairs"), sets, settings, order, late_bits), "second-links")
    return first.unionByName(second)


def jaccard_join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Component of every document under links of similar shingle sets: doc_id, n_shingles, component_id, row, keep_row (the row that stands for the component).

    One row per input row. Null and empty texts and texts without words have no shingle and only themselves; equal sets are one node, so copies are
    linked without pairs. A component without any non-null id has a null component_id; repeated rows get equal results; an empty
    table gives no rows.
    """
    rows = candidate_sets(narrow(docs), settings)
    grouped = rows.where("tokens IS NOT NULL").groupBy("sig").agg(F.first("tokens").alias("tokens"), F.max("loose").alias("loose"))
    sets = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")  # numbers are half as long as digests
    found = components(set_links(sets, settings))
    names = sets.select("id", "sig")
    found = found.join(names.withColumnRenamed("id", "node"), "node").select(F.col("sig").alias("node"), F.col("comp").alias("id"))
    comp = stored(salted_join(found, names, ["id"], ["node"]).select("node", F.col("sig").alias("comp")), "set-components")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    linked = classes.join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = linked.groupBy("comp").agg(F.min("first").alias("keeper"), F.sum("copies").alias("members"))
    found = stored(
        salted_join(linked, named, ["comp"], ["sig"]).where("members > 1").select("sig", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.row").alias("keep_row")), "grouped-sets"
    ).withColumn("grouped", F.lit(True))  # sets with a partner or a copy only
    out = salted_join(rows.select("doc_id", "row", "n", "sig"), found, ["sig"], ["row"], "left")
    own = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "row", F.coalesce("keep_row", "row").alias("keep_row"))


def representatives(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest id, all columns kept; of repeated rows one stays."""
    found = jaccard_join(docs, settings)
    return keep_rows(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("keep_row"))), once=True)


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [concat(len(words), ':', array_to_string(words, ' '))]
    ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w),
  e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (n + m - i)),
  pair AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT pair.a, reach.seen FROM reach JOIN pair ON pair.b = reach.doc_id)
  SELECT s.doc_id, len(sh) AS n_shingles, min(seen) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, sh"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("row", "keep_row")


QUERIES = [Query("op6_ngram_jaccard", op6_ngram_jaccard, SQL)]
