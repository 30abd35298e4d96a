"""Divergence audit between the sources of a language, and the terms by which a source stands out.

Terms are counted once, combined per group inside tasks. A group's kept terms become arrays of (term id, count) sorted by id
and cut into slices of bounded length; one task per unordered pair of groups and slice merges the two arrays by a galloping
intersection and prices the terms that both have, the terms of either side and the terms that both lack. All prices are
integers, so sums do not depend on the order of tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, stored
from sigloom.llm.textops import buffers

SCALE = 1_000_000_000
_HELD = 400_000
_PIECE = 8 << 20
#: bytes of a term keep their value (A-Z lower-cased), all others become spaces
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    """``min_docs``: documents of its language that a kept term is in; ``top``: terms listed per group; ``slice_terms``: terms of a slice."""

    min_docs: int = 10
    top: int = 10
    slice_terms: int = 1 << 16


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some megabytes at a time; cuts fall between terms."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        to = folded.find(b" ", at + _PIECE)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts of this task's terms per (lang, source), given out whenever many are held."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for group, found in counts.items():
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group[0]] * len(terms), pa.string()), pa.array([group[1]] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([found[t] for t in terms], pa.int64()), pa.array([docs[group][t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        data, at = buffers(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for row, group in enumerate(groups):
            own, seen = counts[group], set()
            before = len(own)
            for terms in term_lists(data[at[row] : at[row + 1]].tobytes()):
                own.update(terms)
                seen.update(terms)
            docs[group].update(seen)
            held += len(own) - before
            if held > _HELD:
                yield from emit()
                held = 0
    yield from emit()


def _names(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group and the group's documents that have it."""
    texts = docs.select(*_names(docs), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    parts = texts.mapInArrow(_partial_counts, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """Terms that enough documents of their language have, with the language's ``total`` and one ``lead`` row per term.

    A (lang, term) has a row per source at most, so the window sees no more.
    """
    term = Window.partitionBy("lang", "term")
    marked = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("lead"),
    )
    return marked.where(F.col("docs") >= min_docs).drop("docs")


def price(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, exact; null where no term is kept."""
    below = F.when(terms > 0, total + 2 * terms)
    return 1 + _div((count + 2).cast("decimal(20,0)") * F.lit(SCALE), below)


def _div(above: Column, below: Column) -> Column:
    """Whole part of a division of integers."""
    return F.call_function("div", above, below)


def spread_of(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` in integers."""
    return _div((p - q) * (p - q), p + q)


def _prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``price`` of an array: long division, three digits at a time, so that nothing passes 64 bits."""
    below = total + 2 * terms
    out, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def _spread(p, q):
    return (p - q) * (p - q) // (p + q)


def gallop(short: np.ndarray, long: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that both sorted arrays have.

    Blocks of the shorter one advance through the longer one: steps double until the block's last value is passed, and only
    the stretch stepped over is searched.
    """
    mine, theirs, at = [], [], 0
    for first in range(0, len(short), block):
        part = short[first : first + block]
        step = block
        while at + step < len(long) and long[at + step] < part[-1]:
            step *= 2
        stretch = long[at : at + step + 1]
        place = np.searchsorted(stretch, part)
        hit = place < len(stretch)
        hit[hit] = stretch[place[hit]] == part[hit]
        mine.append(np.flatnonzero(hit) + first)
        theirs.append(place[hit] + at)
        at = min(at + int(place[-1]), len(long))
        if at == len(long):
            break
    empty = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (empty, empty)


def _merge(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Value and number of terms of one slice of a pair of groups; terms that both lack are priced once per pair."""
    known = left if len(left) else right
    terms, totals = int(known["terms"].iloc[0]), [int(known[c].iloc[0]) for c in ("total_a", "total_b")]
    ids, prices, none = [], [], []
    for side, total in zip((left, right), totals):
        row = side.iloc[0] if len(side) else None
        ids.append(np.asarray(row["ids"] if row is not None else [], np.int64))
        prices.append(_prices(np.asarray(row["counts"] if row is not None else [], np.int64), total, terms))
        none.append(int(_prices(np.zeros(1, np.int64), total, terms)[0]))
    if len(ids[0]) <= len(ids[1]):
        a, b = gallop(ids[0], ids[1])
    else:
        b, a = gallop(ids[1], ids[0])
    value = int(_spread(prices[0][a], prices[1][b]).sum())
    for side, shared, other in ((0, a, none[1]), (1, b, none[0])):
        alone = np.ones(len(ids[side]), bool)
        alone[shared] = False
        value += int(_spread(prices[side][alone], other).sum())
    found = len(ids[0]) + len(ids[1]) - len(a)
    return pd.DataFrame({"lang": [key[0]], "a": [key[1]], "b": [key[2]], "value": [value], "found": [found]})


def _pairs(groups: DataFrame) -> DataFrame:
    """Unordered pairs of a language's groups, ``a`` before ``b``; the result lists each of them."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms")
    b = groups.select(F.col("lang").alias("lang_b"), F.col("source").alias("b"), F.col("total").alias("total_b"))
    return a.join(b, (F.col("lang") == F.col("lang_b")) & (F.col("a") < F.col("b"))).drop("lang_b")


def pair_values(kept: DataFrame, groups: DataFrame, slice_terms: int) -> DataFrame:
    """``lang, a, b, value`` of every unordered pair of groups of a language."""
    slices = groups.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / slice_terms)).cast("bigint").alias("slices")).distinct()
    placed = kept.join(slices, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
    ranked = placed.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")))
    entries = F.sort_array(F.collect_list(F.struct("id", "n")))
    arrays = ranked.groupBy("lang", "source", "slice").agg(entries.alias("entries")).select(
        "lang", "source", "slice", F.col("entries.id").alias("ids"), F.col("entries.n").alias("counts")
    )
    arrays, pairs = stored(arrays, "term-arrays"), _pairs(groups)
    sides = [arrays.withColumnRenamed("source", side).join(pairs, ["lang", side]) for side in ("a", "b")]
    keyed = [rows.toDF(*rows.columns).groupBy("lang", "a", "b", "slice") for rows in sides]
    merged = keyed[0].cogroup(keyed[1]).applyInPandas(_merge, "lang string, a string, b string, value bigint, found bigint")
    sums = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("found").alias("found"))
    none = [price(F.lit(0), F.col(total), F.col("terms")) for total in ("total_a", "total_b")]
    lacking = (F.col("terms") - F.coalesce("found", F.lit(0))) * spread_of(*none)
    return pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce("value", F.lit(0)) + F.coalesce(lacking, F.lit(0))).cast("bigint").alias("value")
    )


def standing_out(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a group has more often than its language."""
    p = price(F.col("n"), F.col("total_group"), F.col("terms"))
    q = price(F.col("total"), F.col("total_lang"), F.col("terms"))
    sizes = groups.withColumnRenamed("total", "total_group")
    priced = kept.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    return priced.where("p > q").select("lang", "source", "item", spread_of(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per group (lang, source) its divergence from every other source of its language, and its outstanding terms.

    Columns ``lang, source, part, item, value, rank``: part ``pair`` lists all other sources, part ``term`` the first
    ``settings.top`` terms. Null text, lang and source count as ''. Groups without terms take part; where a language keeps no term,
    its pairs have value 0 and no terms are listed. Equal values rank by the item's UTF-8 bytes. Repeated rows and null ids count
    as documents of their own; other columns are ignored. An empty table gives an empty result.
    """
    settings = settings or Settings()
    kept = stored(kept_terms(term_counts(docs), settings.min_docs), "kept-terms")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_if("lead").alias("terms"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "total_lang", "terms")]
    groups = docs.select(*_names(docs)).distinct().join(by_group, ["lang", "source"], "left").join(by_lang, ["lang"], "left")
    groups = stored(groups.select("lang", "source", *zero), "groups")
    pairs = pair_values(kept, groups, settings.slice_terms)
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    both = pairs.select("lang", "value", F.explode(ways).alias("way"))
    both = both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    rank = F.row_number().over(order).alias("rank")
    terms = standing_out(kept, groups).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value"]
    top = terms.select(*columns, rank).where(F.col("rank") <= settings.top)
    return both.select(*columns, rank).unionByName(top)


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= 10),
    counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS total_lang FROM kept GROUP BY lang),
    groups AS (SELECT b.lang, b.source, coalesce(l.v, 0) AS v, coalesce(l.total_lang, 0) AS total_lang, coalesce(s.total, 0) AS total
        FROM (SELECT DISTINCT lang, source FROM base) b LEFT JOIN langs l USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL) s USING (lang, source)),
    priced AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p,
            1 + 1000000000 * (k.total + 2) // (g.total_lang + 2 * g.v) AS q
        FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM priced WHERE n > 0 AND p > q),
    ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


QUERIES = [Query("op11_source_divergence", _query, SQL)]
