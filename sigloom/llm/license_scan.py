"""Licence scan: units of text against licence templates by the Dice coefficient of word bigrams; DataFrame operations only.

Units are the lines of a document, where it has several its whole text, and runs of words across lines: from every
word, of lengths inside the size bounds of each template. Only documents with a word that no match can do without are
cut into bigrams at all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, narrow, stored

THRESHOLD = 0.8
#: template bigrams up to this many (some ten megabytes) are sent to every task; more are joined by a shuffle
BROADCAST_ROWS = 100_000
#: lengths of runs tried first for each template, the shortest and the longest that can match among them
LENGTHS = 17
#: notices and openings of well-known licences
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
}


#: whole licences as distributed, without title and copyright lines where these differ from file to file
TEXTS = {
    name: resources.files("sigloom.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0")
}
KNOWN = TEMPLATES | TEXTS
#: words of ordinary prose; they only decide the order in which words are tried as telling ones
_PLAIN = frozenset(
    "a above all also an and any are as at be but by can do each following for from has have if in including is it its made may more must no not of "
    "on only or other out part provided shall such that the their them then there these they this to under use used version was where which "
    "with within without work you your".split()
)


def template_bigrams(text: str) -> Counter:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of a unit whose Dice coefficient with a template of ``size`` bigrams can reach the threshold."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def normal_lines(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and line feeds becomes a space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def telling_words(bag: Counter, least: int) -> set[str]:
    """Words of which every unit holds one that shares ``least`` bigrams with the template: the bigrams without them are fewer."""
    words = sorted({w for bigram in bag for w in bigram.split()}, key=lambda w: (w in _PLAIN, w.isdigit(), -len(w), w))
    out, rest = set(), bag
    for word in words:
        if rest.total() < least:
            break
        out.add(word)
        rest = Counter({bigram: n for bigram, n in rest.items() if word not in bigram.split()})
    return out


def run_lengths(size: int, low: int, high: int) -> list[int]:
    """Lengths from ``low`` to ``high`` in about equal ratios, ``size`` among them; all of them where they are few."""
    if high - low < LENGTHS:
        return list(range(low, high + 1))
    return sorted({round(low * (high / low) ** (i / (LENGTHS - 1))) for i in range(LENGTHS)} | {low, size, high})


def _lines(normal: Column) -> Column:
    return F.split(normal, "\n")


def line_matches(rows: DataFrame, table: DataFrame, least: int, most: int, threshold: float) -> DataFrame:
    """Matches of whole texts (unit_no 0) and lines (from 1): doc_id, row, unit_no, license, dice."""
    lines = _lines(F.col("normal"))
    whole = F.array(F.replace("normal", F.lit("\n"), F.lit(" ")))
    units = rows.select("doc_id", "row", F.posexplode(F.when(F.size(lines) > 1, F.concat(whole, lines)).otherwise(whole)).alias("unit_no", "unit"))
    words = F.array_remove(F.split("unit", " "), "")
    sized = units.select("doc_id", "row", "unit_no", words.alias("words")).withColumn("size", F.size("words") - 1)
    sized = sized.where((F.col("size") >= max(1, least)) & (F.col("size") <= most))
    pairs = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.concat(F.col("words")[i], F.lit(" "), F.col("words")[i + 1]))
    bigrams = sized.select("doc_id", "row", "unit_no", "size", F.explode(pairs).alias("bigram"))
    shared = bigrams.join(table, "bigram").where((F.col("size") >= F.col("low")) & (F.col("size") <= F.col("high")))
    unit = ["doc_id", "row", "unit_no", "license", "size", "t_size"]
    counted = shared.groupBy(*unit, "bigram", "known").agg(F.count(F.lit(1)).alias("n"))
    common = counted.groupBy(*unit).agg(F.sum(F.least("n", "known")).alias("common"))
    dice = 2 * F.col("common") / (F.col("size") + F.col("t_size"))
    return common.withColumn("dice", F.round(dice, 9)).where(F.col("dice") >= threshold).select("doc_id", "row", "unit_no", "license", "dice")


_DOC = ["id", "row", "license"]


def shared_places(rows: DataFrame, table: DataFrame, matched: DataFrame) -> DataFrame:
    """Where documents that can match a template hold its bigrams: id, row, license, place, before, n, t_size, low.

    A bigram at ``place`` counts in the runs that start behind ``before``: earlier starts have as many of it as the template.
    Bigrams that touch a line that matched the template itself are left out. ``n`` is the document's number of bigrams.
    """
    worded = F.flatten(F.transform(
        _lines(F.col("normal")),
        lambda line, i: F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.struct(w.alias("word"), (i + 1).alias("line"))),
    ))
    texts = rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row", worded.alias("words")).withColumn("n", F.size("words") - 1)
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        i.alias("place"), F.concat(F.col("words")[i]["word"], F.lit(" "), F.col("words")[i + 1]["word"]).alias("bigram"),
        F.col("words")[i]["line"].alias("line"), F.col("words")[i + 1]["line"].alias("next_line"),
    ))
    found = texts.where("n >= 1").select("id", "row", "n", F.explode(pairs).alias("b")).select("id", "row", "n", "b.*").join(table, "bigram")
    # repeated rows meet here, so a place counts once
    places = found.groupBy(*_DOC, "bigram", "known", "n", "t_size", "low").agg(F.sort_array(F.collect_set(F.struct("place", "line", "next_line"))).alias("at"))
    done = matched.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row", "license").agg(F.collect_set("unit_no").alias("done"))
    places = places.join(done, _DOC, "left").withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
    places = places.where(~F.array_contains("done", 0)).withColumn("at", F.filter("at", lambda p: ~(
        F.array_contains(F.col("done"), p["line"]) | F.array_contains(F.col("done"), p["next_line"])
    )))
    # a row per bigram of a template: a partition is no larger than the template
    enough = F.sum(F.least(F.size("at").cast("bigint"), F.col("known"))).over(Window.partitionBy(*_DOC))
    places = places.withColumn("enough", enough).where(F.col("enough") >= F.col("low"))
    ranked = F.transform("at", lambda p, i: F.struct(
        p["place"].alias("place"), F.when(i >= F.col("known"), F.get(F.col("at"), (i - F.col("known")).cast("int"))["place"]).otherwise(F.lit(-1)).alias("before"),
    ))
    return places.select(*_DOC, "n", "t_size", "low", F.explode(ranked).alias("p")).select(*_DOC, "n", "t_size", "low", "p.*")


def runs(places: DataFrame) -> DataFrame:
    """Bigrams that a run shares with the template, from every place and for every length of ``places``: id, row, license, length, start, common, size, dice.

    A place counts in the runs that start from behind ``before``, or as far back as the run reaches, up to the place itself: one
    step up and one down, whose sums in the order of the starts are the counts. A run ends with its text.
    """
    first = F.greatest(F.col("before") + 1, F.col("place") - F.col("length") + 1)
    unit = [*_DOC, "length", "n", "t_size"]
    steps = F.array(
        F.struct(first.alias("start"), F.lit(1).alias("step"), F.lit(0).alias("here")),
        F.struct(F.col("place").alias("start"), F.lit(0).alias("step"), F.lit(1).alias("here")),
        F.struct((F.col("place") + 1).alias("start"), F.lit(-1).alias("step"), F.lit(0).alias("here")),
    )
    summed = places.select(*unit, F.explode(steps).alias("s")).groupBy(*unit, "s.start").agg(F.sum("s.step").alias("step"), F.max("s.here").alias("here"))
    common = F.sum("step").over(Window.partitionBy(*_DOC, "length").orderBy("start"))
    size = F.least(F.col("length"), F.col("n") - F.col("start"))
    return summed.withColumn("common", common).where("here = 1").withColumn("size", size).withColumn(
        "dice", F.round(2 * F.col("common") / (F.col("size") + F.col("t_size")), 9)
    )


def run_matches(rows: DataFrame, table: DataFrame, lengths: DataFrame, matched: DataFrame, threshold: float) -> DataFrame:
    """Matches of runs of words: doc_id, row, unit_no (minus the number of the first word), license, dice. Runs that overlap are one match.

    All starts are tried with the lengths of ``run_lengths``. A length between two of them shares no more than the longer one, so it can
    reach the threshold only where the longer one's count would do for the shorter length; where that is so and no run
    has matched, all the lengths between are tried too. No match is lost, the Dice is the best of the lengths tried.
    """
    places = stored(shared_places(rows, table, matched), "license-places")
    shorter = F.coalesce(F.lag("length").over(Window.partitionBy("license").orderBy("length")), F.col("length"))
    lengths = lengths.withColumn("shorter", shorter)
    tried = runs(places.join(F.broadcast(lengths.drop("shorter")), "license"))
    close = 2 * F.col("common") / (F.least(F.col("shorter") + 1, F.col("size")) + F.col("t_size")) >= F.lit(threshold) - 1e-9
    tried = tried.join(F.broadcast(lengths), ["license", "length"]).withColumn("close", close).where(close)
    tried = stored(tried.select(*_DOC, "length", "shorter", "start", "size", "dice"), "license-runs")
    best = tried.groupBy(*_DOC).agg(F.max("dice").alias("best")).where(F.col("best") < threshold).select(*_DOC)
    between = tried.where("length > shorter + 1").join(best, _DOC, "left_semi").select(
        *_DOC, F.explode(F.sequence(F.col("shorter") + 1, F.col("length") - 1)).alias("length")
    ).distinct()
    columns = [*_DOC, "start", "size", "dice"]
    every = tried.select(*columns).unionByName(runs(places.join(between, _DOC)).select(*columns)).where(F.col("dice") >= threshold)
    order = Window.partitionBy(*_DOC).orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") > reached, 1).otherwise(0)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("fresh", fresh).withColumn("island", island)
    chosen = every.groupBy(*_DOC, "island").agg(F.min(F.struct((-F.col("dice")).alias("worse"), "start")).alias("b"))
    return chosen.select(
        F.when(F.col("id") != 2**63 - 1, F.col("id")).alias("doc_id"), "row", (-F.col("b.start") - 1).alias("unit_no"), "license", (-F.col("b.worse")).alias("dice")
    )


def license_matches(docs: DataFrame, templates: Mapping[str, str] = KNOWN, threshold: float = THRESHOLD) -> DataFrame:
    """Every (unit, template) at or above the threshold: doc_id, row, unit_no, license, dice.

    ``unit_no`` is 0 for the whole text, counts lines from 1, and is minus the number of its first word for a run of words; a run is not told
    again where the whole text or its line matched the same template. Bigrams count as often as they occur. Templates with fewer than two words match nothing.
    """
    spark = docs.sparkSession
    bags = {name: bag for name, text in templates.items() if (bag := template_bigrams(text))}
    known = [(name, bigram, n, bag.total(), *size_bounds(bag.total(), threshold)) for name, bag in bags.items() for bigram, n in bag.items()]
    table = spark.createDataFrame(known, "license string, bigram string, known int, t_size int, low int, high int")
    if len(known) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    least, most = min((k[4] for k in known), default=1), max((k[5] for k in known), default=0)
    sizes = {name: (bag.total(), *size_bounds(bag.total(), threshold)) for name, bag in bags.items()}
    lengths = spark.createDataFrame([(name, n) for name, s in sizes.items() for n in run_lengths(*s)], "license string, length int")
    # a match of any size shares at least ``low`` bigrams
    telling = sorted(set().union(*(telling_words(bag, sizes[name][1]) for name, bag in bags.items())))
    words = F.split(F.replace(normal_lines(F.col("text")), F.lit("\n"), F.lit(" ")), " ")
    rows = narrow(docs).where(F.arrays_overlap(words, F.array(*map(F.lit, telling)).cast("array<string>")))
    rows = stored(rows.select("doc_id", "row", normal_lines(F.col("text")).alias("normal")), "license-texts")
    lines = stored(line_matches(rows, table, least, most, threshold), "license-lines")
    return lines.unionByName(run_matches(rows, table, lengths, lines, threshold))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = KNOWN, threshold: float = THRESHOLD) -> DataFrame:
    """The best licence of every document: doc_id, n_matches (units and templates), license, unit_no, dice.

    One row per input row; without a match n_matches is 0 and the rest null. Ties go to the first name, then the first unit. Null and
    empty texts match nothing; a null doc_id stays null; repeated rows get equal results; an empty table gives no rows.
    """
    best = F.min(F.struct((-F.col("dice")).alias("worse"), "license", "unit_no"))
    found = license_matches(docs, templates, threshold).groupBy("doc_id", "row").agg(
        F.countDistinct("unit_no", "license").alias("n_matches"), best.alias("best")
    )
    last = F.lit(2**63 - 1)
    keyed = found.select(F.coalesce("doc_id", last).alias("id"), "row", "n_matches", "best")
    every = narrow(docs).select("doc_id", F.coalesce("doc_id", last).alias("id"), "row")
    return every.join(keyed, ["id", "row"], "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"), F.col("best.license").alias("license"),
        F.col("best.unit_no").alias("unit_no"), (-F.col("best.worse")).alias("dice"),
    )


def _sql() -> str:
    rows = ", ".join(
        f"('{name}', '{bigram}', {n}, {bag.total()}, {size_bounds(bag.total(), THRESHOLD)[0]}, {size_bounds(bag.total(), THRESHOLD)[1]})"
        for name, bag in ((name, template_bigrams(text)) for name, text in TEMPLATES.items()) for bigram, n in bag.items()
    )
    return rf"""WITH t(license, bigram, known, t_size, low, high) AS (VALUES {rows}),
  n AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS normal FROM documents),
  u AS (SELECT doc_id, 0 AS unit_no, replace(normal, chr(10), ' ') AS unit FROM n UNION ALL
    SELECT doc_id, unnest(generate_series(1, len(string_split(normal, chr(10))))) AS unit_no, unnest(string_split(normal, chr(10))) AS unit
    FROM n WHERE contains(normal, chr(10))),
  w AS (SELECT doc_id, unit_no, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM u),
  b AS (SELECT doc_id, unit_no, len(words) - 1 AS size, unnest(list_transform(generate_series(1, len(words) - 1), lambda i: concat(words[i], ' ', words[i + 1]))) AS bigram
    FROM w WHERE len(words) BETWEEN 2 AND 200),
  c AS (SELECT doc_id, unit_no, license, size, t_size, bigram, known, count(*) AS n FROM b JOIN t USING (bigram)
    WHERE size BETWEEN low AND high GROUP BY ALL),
  m AS (SELECT doc_id, unit_no, license, round(2 * sum(least(n, known)) / (size + t_size), 9) AS dice FROM c GROUP BY doc_id, unit_no, license, size, t_size),
  f AS (SELECT doc_id, count(*) AS n_matches, min({{'worse': -dice, 'license': license, 'unit_no': unit_no}}) AS best FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id)
  SELECT doc_id, coalesce(n_matches, 0) AS n_matches, best.license AS license, best.unit_no AS unit_no, -best.worse AS dice
  FROM documents LEFT JOIN f USING (doc_id)"""


SQL = _sql()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


QUERIES = [Query("op3_license_scan", op3_license_scan, SQL)]
