"""Mixing sources to target weights by hierarchical budgeting; DataFrame operations only.

A token budget runs down a tree of domain, language and source. At every node the children share the node's
budget by weight, none above its capacity (its tokens times the allowed epochs); what a full child cannot
take goes to its siblings first, and since a node's capacity is the sum of its children's, only what a whole
family cannot take reaches the siblings of the ancestors. A leaf then takes its documents once per full epoch
and, in the last epoch, a token prefix of a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, row_key, stored, text_of
from sigloom.operators.skew import salted_join

LEVELS = ("domain", "lang", "source")
#: the shares of the registered query and of the pipeline; names that are not listed weigh 1
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
BUDGET_SHARE = 0.7
MAX_EPOCHS = 2
SEED = 17
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    """Number of words; plain replacements and a split at one letter, which need no pattern matching."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("bigint")


def domain_of(source: Column) -> Column:
    """Domain of a source name that ends in a number; any other source is of domain ``other``."""
    number = F.substring(source, 4, 9).try_cast("int") % 3
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("other")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("bigint")
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight).cast("bigint")).otherwise(out)
    return out


def share_out(children: DataFrame, parent: Sequence[str], level: str, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``budget`` of every child from its parent's ``given``, by weight and below ``capacity``.

    Children fill up in the order of capacity per weight; the first that does not fill sets the level
    of all behind it. Whole numbers are kept exact, so no order of summing matters. Partitions are families of
    the tree, whose size is the number of its names, not of documents.
    """
    rows = children.withColumn("weight", _weight(level, weights)).withColumn(
        "fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    )
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy("fill", level)
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("water", F.when(behind > 0, (F.col("given") - full) / behind))
    rows = rows.withColumn("is_full", F.coalesce(F.col("fill") <= F.col("water"), F.lit(False)))
    surface = F.max(F.when(~F.col("is_full"), F.col("water"))).over(family)
    rows = rows.withColumn("surface", F.coalesce(surface, F.lit(0.0)))
    budget = F.when(F.col("is_full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.greatest("surface", F.lit(0.0))))
    return rows.withColumn("budget", F.least(budget.cast("bigint"), F.col("capacity"))).drop("weight", "fill", "water", "is_full", "surface")


def leaf_budgets(leaves: DataFrame, weights, budget_share: float, max_epochs: int) -> DataFrame:
    """Budget of every leaf of the tree from ``leaves`` (the level columns and ``tokens``)."""
    caps = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("bigint"))
    spent: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = caps.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if spent is None:  # one row for each domain
            every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("given", F.floor(every * F.lit(float(budget_share))).cast("bigint"))
        else:
            nodes = nodes.join(spent, parent)
        shared = share_out(nodes, parent, level, weights)
        spent = shared.select(*own, F.col("budget").alias("given"))
    return leaves.join(spent.withColumnRenamed("given", "budget"), list(LEVELS))


def _order(epoch: Column) -> Column:
    """Seeded place of a document in an epoch, as 32 hexadecimal digits."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), doc_id))


def mix(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How often every document is taken: doc_id, domain, lang, source, n_tokens, budget (of its leaf), times, row.

    One row per input row. A null lang or source counts as the name ``(none)``, a null text as no token; a null doc_id stays null.
    Documents of one leaf with equal ids (repeated rows) are taken together or not at all; a document without tokens is taken when
    its place in the order lies inside the prefix. An empty table gives no rows.
    """
    doc_id, text = docs["doc_id"].cast("bigint"), text_of(docs)
    source = F.coalesce(docs["source"].cast("string"), F.lit("(none)"))
    slim = docs.select(
        doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), domain_of(source).alias("domain"),
        F.coalesce(docs["lang"].cast("string"), F.lit("(none)")).alias("lang"), source.alias("source"), word_count(text).alias("n_tokens"),
    )
    slim = stored(slim, "mixing")  # texts are read and counted once
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, budget_share, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("bigint")
    budgets = budgets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    budgets = stored(budgets.select(*LEVELS, "budget", "epochs", "rest"), "mixing-budgets")  # one row per leaf

    placed = salted_join(slim, budgets, LEVELS, ["row"]).withColumn("place", _order(F.col("epochs")))
    placed = placed.withColumn("bucket", F.conv(F.substring("place", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    # the prefix ends in one of 16^4 buckets of a leaf: earlier ones are in, later ones out, only that one is sorted
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    up_to = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    borders = (
        sums.withColumn("up_to", up_to).where("up_to > rest").groupBy(*LEVELS)
        .agg(F.min(F.struct("bucket", (F.col("up_to") - F.col("tokens")).alias("before"))).alias("b"))
        .select(*LEVELS, F.col("b.bucket").alias("border"), F.col("b.before").alias("before"))
    )
    borders = stored(borders, "mixing-borders")  # one row per leaf at most
    ranked = salted_join(placed, borders, LEVELS, ["row"], "left")
    inside = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    more = F.sum("n_tokens").over(
        Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = ranked.where(inside).withColumn("more", more)
    sure = ranked.where(~inside).withColumn("more", F.lit(None).cast("bigint"))
    every = sure.unionByName(cut)
    taken = (F.col("rest") > 0) & F.when(F.col("more").isNotNull(), F.col("before") + F.col("more") <= F.col("rest")).otherwise(
        F.col("border").isNull() | (F.col("bucket") < F.col("border"))
    )
    return every.select(
        "doc_id", *LEVELS, "n_tokens", "budget", (F.col("epochs") + taken.cast("int")).cast("bigint").alias("times"), "row"
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as its leaf's budget takes it."""
    last = F.lit(2**63 - 1)
    taken = mix(docs, **settings).where("times > 0")
    keys = taken.select(F.coalesce("doc_id", last).alias("__mix_id"), F.col("row").alias("__mix_row"), F.col("times").alias("__mix_times")).distinct()
    doc_id = docs["doc_id"].cast("bigint")
    own = docs.select(
        *[docs[c] for c in docs.columns], F.coalesce(doc_id, last).alias("__mix_id"), row_key(doc_id, text_of(docs)).alias("__mix_row")
    )
    copies = own.join(keys, ["__mix_id", "__mix_row"]).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__mix_times"))))
    return copies.drop("__mix_id", "__mix_row", "__mix_times", "__mix_copy")


def _share_sql(name: str, nodes: str, parent: str, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"CAST(CASE {level} {cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""{name}_w AS (SELECT *, {weight} AS weight, capacity / {weight} AS fill FROM ({nodes})),
  {name}_l AS (SELECT *, (given - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM {name}_w WINDOW o AS ({by} ORDER BY fill, {level})),
  {name} AS (SELECT *, CASE WHEN fill <= water THEN capacity ELSE least(capacity, CAST(floor(weight * greatest(0.0,
      max(CASE WHEN fill > water THEN water END) OVER ({by}))) AS BIGINT)) END AS budget FROM {name}_l)"""


def _prefix_sql() -> str:
    keys = ", ".join(LEVELS)
    return rf"""WITH n AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
  d AS (SELECT *, CASE TRY_CAST(substr(source, 4, 9) AS INTEGER) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS domain FROM n),
  leaves AS (SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM d GROUP BY ALL),
  {_share_sql('l1', f"SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST({BUDGET_SHARE} AS DOUBLE)) AS BIGINT) FROM leaves) AS given FROM leaves GROUP BY domain", "", "domain")},
  {_share_sql('l2', "SELECT domain, lang, CAST(sum(v.capacity) AS BIGINT) AS capacity, any_value(p.budget) AS given FROM leaves v JOIN l1 p USING (domain) GROUP BY domain, lang", "domain", "lang")},
  {_share_sql('l3', "SELECT domain, lang, source, v.capacity, p.budget AS given FROM leaves v JOIN l2 p USING (domain, lang)", "domain, lang", "source")},
  e AS (SELECT {keys}, l3.budget, CASE WHEN tokens > 0 THEN l3.budget // tokens ELSE 0 END AS epochs,
    l3.budget - CASE WHEN tokens > 0 THEN l3.budget // tokens ELSE 0 END * tokens AS rest FROM l3 JOIN leaves USING ({keys})),
  p AS (SELECT d.*, e.budget, e.epochs, e.rest, sum(n_tokens) OVER (PARTITION BY {keys}
    ORDER BY md5(concat('{SEED}:', e.epochs, ':', doc_id)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to FROM d JOIN e USING ({keys}))
  SELECT doc_id, {keys}, n_tokens, budget, epochs + CASE WHEN rest > 0 AND up_to <= rest THEN 1 ELSE 0 END AS times FROM p"""


SQL = _prefix_sql()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("row")


QUERIES = [Query("op9_mixing", op9_mixing, SQL)]
