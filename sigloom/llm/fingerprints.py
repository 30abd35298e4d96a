"""Document fingerprints: invertible Bloom lookup tables over the digests of paragraphs.

A paragraph is a run of words of one line, at most ``words`` of them. Its digest goes into three cells, one of each subtable; a cell
holds how many digests it has, their exclusive or, and that of their checks. Cells of two versions subtract, equal paragraphs vanish,
and peeling cells with a single digest gives the digests that differ. Where that gets stuck, both versions are sketched four times
larger. Sketching and peeling are column functions of one row: a group is a sorted array's run of equal cells, so a text of any length
takes n log n steps, and no shuffle but that of the texts themselves is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, stored, text_of

TABLES = 3
_ROUNDS = 64
_LEVELS = 12
_CELLS = "array<struct<cell:bigint,n:bigint,x:bigint,c:bigint>>"
_LAST = "decimal(19,0)"


def _null_key() -> Column:
    """Key of null ids, behind all others."""
    return F.lit(str(2**63)).cast(_LAST)


@dataclass(frozen=True)
class Settings:
    """``words`` of a paragraph at most; ``cells`` of a subtable of the smallest sketch, a power of two."""

    words: int = 32
    cells: int = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column, words: int) -> Column:
    """Distinct digests of a text's paragraphs."""
    paragraphs = F.regexp_extract_all(text, F.lit(rf"(?:\S++[^\S\n]*+){{1,{words}}}"), F.lit(0))
    return F.array_distinct(F.transform(paragraphs, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(7)), 32)


def _entries(digest: Column, size: Column, n: Column) -> Column:
    """A digest's three cells, picked by bits of its own."""
    return let(
        F.struct(digest.alias("x"), _check(digest).alias("c"), n.cast("bigint").alias("n")),
        lambda d: F.array(
            *[
                F.struct(
                    (F.shiftrightunsigned(d["x"], 20 * table).bitwiseAND(size - 1) + table * size).alias("cell"),
                    d["n"].alias("n"), d["x"].alias("x"), d["c"].alias("c"),
                )
                for table in range(TABLES)
            ]
        ),
    )


def _summed(entries: Column) -> Column:
    """Entries of a cell as one, in order; cells with nothing left go."""

    def merged(a: Column, b: Column) -> Column:
        return F.struct(
            a["cell"].alias("cell"), (a["n"] + b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x"), a["c"].bitwiseXOR(b["c"]).alias("c")
        )

    def cells(r: Column) -> Column:
        def total(at: Column, k: Column) -> Column:
            return F.aggregate(F.slice(r["rows"], at + 2, r["at"][k + 1] - at - 1), r["rows"][at], merged)

        return F.transform(F.slice(r["at"], 1, F.size(r["at"]) - 1), total)

    def runs(rows: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (rows[i]["cell"] != F.get(rows, i - 1)["cell"]))
        starts = F.struct(rows.alias("rows"), F.concat(first, F.array(F.size(rows))).alias("at"))
        return F.when(F.size(rows) == 0, rows).otherwise(let(starts, cells))

    return F.filter(let(F.sort_array(entries), runs), lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0)).cast(_CELLS)


def sketch(found: Column, size: Column) -> Column:
    """Cells in use of the sketch of an array of digests, in order, with ``size`` cells in each subtable."""
    return _summed(F.flatten(F.transform(found, lambda d: _entries(d, size, F.lit(1)))).cast(_CELLS))


def subtract(mine: Column, theirs: Column) -> Column:
    """Cells of what differs: positive where only ``mine`` has it."""
    less = F.transform(theirs, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["x"].alias("x"), c["c"].alias("c")))
    return _summed(F.concat(mine, less.cast(_CELLS)))


def peel(cells: Column, size: Column) -> Column:
    """``only`` (digest, sign) recovered from a difference, and the ``cells`` that are left: none if all of it was."""
    state = f"struct<stuck:boolean,cells:{_CELLS},only:array<struct<x:bigint,n:bigint>>>"

    def alone(cells: Column, sign: int) -> Column:
        found = F.filter(cells, lambda c: (c["n"] == sign) & (_check(c["x"]) == c["c"]))
        return F.transform(F.array_distinct(F.transform(found, lambda c: c["x"])), lambda x: F.struct(x.alias("x"), F.lit(sign).cast("bigint").alias("n")))

    def less(cells: Column, got: Column) -> Column:
        return _summed(F.concat(cells, F.flatten(F.transform(got, lambda g: _entries(g["x"], size, -g["n"]))).cast(_CELLS)))

    def step(acc: Column, _: Column) -> Column:
        got = F.concat(alone(acc["cells"], 1), alone(acc["cells"], -1))
        out = let(
            F.struct(acc.alias("acc"), got.alias("got")),
            lambda s: F.when(
                F.size(s["got"]) == 0, F.struct(F.lit(True).alias("stuck"), s["acc"]["cells"].alias("cells"), s["acc"]["only"].alias("only")).cast(state)
            ).otherwise(
                let(
                    less(s["acc"]["cells"], s["got"]),
                    lambda left: F.struct((F.size(left) == 0).alias("stuck"), left.alias("cells"), F.concat(s["acc"]["only"], s["got"]).alias("only")),
                ).cast(state)
            ),
        )
        return F.when(acc["stuck"], acc).otherwise(out)

    begin = let(cells, lambda c: F.struct((F.size(c) == 0).alias("stuck"), c.alias("cells"), F.array().alias("only")).cast(state))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), begin, step)


def difference(mine: Column, theirs: Column, cells: int, first: Column | None = None) -> Column:
    """Digests that only one of two arrays has, by sketches that grow until they can be peeled.

    ``first`` may give the difference of the smallest sketches. The result is null if the largest sketch, of over 10^8 cells, gets stuck.
    """
    state = "struct<done:boolean,only:array<struct<x:bigint,n:bigint>>>"

    def attempt(acc: Column, level: Column) -> Column:
        def sized(size: Column) -> Column:
            cells_at = subtract(sketch(mine, size), sketch(theirs, size))
            return peel(cells_at if first is None else F.when(level == 0, first).otherwise(cells_at), size)

        again = let(F.call_function("shiftleft", F.lit(cells).cast("bigint"), 2 * level), lambda size: let(sized(size), lambda p: F.struct((F.size(p["cells"]) == 0).alias("done"), p["only"].alias("only")).cast(state)))
        return F.when(acc["done"], acc).otherwise(again).cast(state)

    start = F.struct(F.lit(False).alias("done"), F.array().alias("only")).cast(state)
    tried = F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, attempt)
    return let(tried, lambda t: F.when(t["done"], t["only"]))


def likeness(mine: Column, only: Column) -> Column:
    """Shared digests over all, from one side's digests and the signed difference; two texts without any are alike."""
    gone = F.size(F.filter(only, lambda d: d["n"] > 0))
    both = F.size(mine) + F.size(only) - gone
    return F.when(both == 0, F.lit(1.0)).otherwise((F.size(mine) - gone) / both)


def written(text: Column, found: Column, cells: Column) -> Column:
    """A fingerprint as text: digest of all, number of paragraphs, and the smallest sketch's cells in use."""
    hexed = F.transform(cells, lambda c: F.concat_ws(":", c["cell"].cast("string"), c["n"].cast("string"), F.hex(c["x"]), F.hex(c["c"])))
    return F.concat_ws("|", F.hex(F.xxhash64(text)), F.size(found).cast("string"), F.array_join(hexed, ","))


def following(ids: DataFrame, parts: int) -> DataFrame:
    """``key, next``: every key with the next larger one, the last with the first.

    Keys are cut into ranges, each ordered on its own; only the first keys of the ranges are ordered together.
    """
    ranged = stored(ids.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(everything)).alias("after"))
    inside = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return inside.join(after, "part").withColumn("next", F.coalesce("next", "after")).drop("part", "after")


def edited_texts(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text, edited, next``: each text, its edited version, and the paragraph digests of the next document's text.

    Texts cross the network once: a document sends the next one's place only its number, and gets back as many code points as it needs.
    """
    spark = docs.sparkSession
    key = F.coalesce(docs["doc_id"].cast("bigint").cast(_LAST), _null_key())
    rows = docs.select(key.alias("key"), text_of(docs).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    sizes = rows.groupBy("key").agg(F.max(quarter).alias("quarter"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = stored(following(sizes, parts).select(F.col("next").alias("key"), F.col("key").alias("before"), "quarter"), "wanted")
    sent = rows.join(wanted, "key").select(
        "before", F.sha2("text", 256).alias("sha"), F.substring("text", F.lit(1), F.col("quarter")).alias("head"), digests(F.col("text"), words).alias("next")
    )
    heads = sent.groupBy("before").agg(F.min(F.struct("sha", "head", "next")).alias("best")).select(F.col("before").alias("key"), "best.head", "best.next")
    kept = F.substring("text", F.lit(1), F.length("text") - quarter)
    doc_id = F.when(F.col("key") < _null_key(), F.col("key").cast("bigint"))
    return rows.join(heads, "key", "left").select(
        doc_id.alias("doc_id"), "text", F.concat(kept, F.substring("head", F.lit(1), quarter)).alias("edited"), "next"
    )


def fingerprints(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Fingerprints of every text and its edited version, and how like they are.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed, added``; the last two are the
    paragraph digests that the edit took and brought, as peeled. Null text counts as empty. A null id ranks behind all others; of rows
    that share an id the next document is the one whose text has the smallest SHA-256. A single document follows itself. Fingerprints of
    equal texts are equal. Repeated rows give repeated results; other columns are ignored. An empty table gives an empty result.
    """
    settings = settings or Settings()
    size = F.lit(settings.cells).cast("bigint")

    def compared(d: Column) -> Column:
        return let(
            F.struct(d.alias("d"), sketch(d["own"], size).alias("own"), sketch(d["edited"], size).alias("edited")),
            lambda s: F.struct(
                written(s["d"]["text"], s["d"]["own"], s["own"]).alias("fingerprint"),
                written(s["d"]["edited_text"], s["d"]["edited"], s["edited"]).alias("edited_fingerprint"),
                difference(s["d"]["own"], s["d"]["edited"], settings.cells, subtract(s["own"], s["edited"])).alias("change"),
                difference(s["d"]["own"], s["d"]["next"], settings.cells).alias("step"),
                s["d"]["own"].alias("own"),
            ),
        )

    rows = edited_texts(docs, settings.words)
    known = F.struct(
        F.col("text"), F.col("edited").alias("edited_text"), digests(F.col("text"), settings.words).alias("own"),
        digests(F.col("edited"), settings.words).alias("edited"), F.col("next"),
    )
    found = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), let(known, compared).alias("found"))
    signed = lambda sign: F.transform(F.filter("found.change", lambda c: c["n"] == sign), lambda c: c["x"])
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "found.fingerprint", "found.edited_fingerprint",
        likeness(F.col("found.own"), F.col("found.change")).alias("near_edited"), likeness(F.col("found.own"), F.col("found.step")).alias("near_next"),
        signed(1).alias("removed"), signed(-1).alias("added"),
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).drop("removed", "added")


QUERIES = [Query("op13_fingerprints", _query)]
