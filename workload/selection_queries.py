"""Selection: groups, predicates, datasets, members, numbering and experiment grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import selection as sel
from sigloom.plans.grid import experiment_grid
from sigloom.plans.select import select_sequences
from workload.base import Registry, table

REGISTRY = Registry()

META = """meta AS (SELECT d.doc_id AS id, d.doc_id AS entry_no, d.lang AS subtype, d.source, d.text,
  coalesce(l.toxic = 1, false) AS recombinant FROM documents d LEFT JOIN labels l USING (doc_id)),
  grps AS (SELECT subtype AS g FROM meta WHERE subtype IS NOT NULL AND subtype <> ''
    GROUP BY subtype HAVING count(*) >= 120)"""

MIN_PTS = 120
DATASET = {"archive": "docs", "archive_folder": "whole", "metadata": "docs"}


def metadata(spark, sf_dir, with_text=False):
    docs = table(spark, sf_dir, "documents")
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("recombinant"))
    extra = ["text"] if with_text else []
    return docs.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("entry_no"), F.col("lang").alias("subtype"), "source",
        "recombinant", *extra,
    )


def _groups(spark, sf_dir):
    return sel.groups_by_value(metadata(spark, sf_dir), "subtype", MIN_PTS)


@REGISTRY.query(f'WITH {META} SELECT g AS "group", g AS "values" FROM grps')
def groups_with_minimum(spark, sf_dir):
    groups = sel.make_groups(
        metadata(spark, sf_dir),
        {"selection_key": "subtype", "min_group_pts": MIN_PTS},
        lambda options, meta: sel.groups_by_value(meta, options["selection_key"], options["min_group_pts"]),
    )
    return groups.withColumn("values", F.array_join("values", ","))


@REGISTRY.query(f'WITH {META} SELECT id, source, g AS "group" FROM meta JOIN grps ON g = subtype WHERE NOT recombinant')
def pick_group_by_value(spark, sf_dir):
    kept = sel.exclude_flagged(metadata(spark, sf_dir), "recombinant", include=False)
    return sel.pick_group(kept, _groups(spark, sf_dir), "subtype").select("id", "source", "group")


@REGISTRY.query(f"""WITH {META} SELECT id, "group" FROM (
  SELECT id, 'romance' AS "group" FROM meta WHERE subtype IN ('fr', 'es')
  UNION ALL SELECT id, 'flagged' FROM meta WHERE recombinant
  UNION ALL SELECT id, 'all-en' FROM meta WHERE subtype = 'en')""")
def pick_group_by_function(spark, sf_dir):
    groups = [
        {"group": "romance", "values": ["fr", "es"]},
        {"group": "flagged", "flagged": True},
        {"group": "all-en", "values": ["en"]},
    ]

    def choose(meta, group, options):
        if group.get("flagged"):
            return meta.where(F.coalesce("recombinant", F.lit(False)))
        return F.col(options["selection_key"]).isin(group["values"])

    picked = sel.pick_by_function(metadata(spark, sf_dir), groups, choose, {"selection_key": "subtype"})
    return picked.select("id", "group")


@REGISTRY.query(f"""WITH {META} SELECT id, subtype FROM meta WHERE subtype IN ('de', 'fr')""")
def value_in_group_values(spark, sf_dir):
    meta = metadata(spark, sf_dir).withColumn("values", F.array(F.lit("de"), F.lit("fr")))
    return meta.where(sel.value_in_group("subtype")).select("id", "subtype")


@REGISTRY.query(f"""WITH {META} SELECT 'subtype' AS key, subtype AS "group", count(*) AS n FROM meta GROUP BY ALL
  UNION ALL SELECT 'source', source, count(*) FROM meta GROUP BY ALL""")
def label_by_key(spark, sf_dir):
    meta = metadata(spark, sf_dir)
    parts = [
        sel.label_by(meta, key).groupBy("group").agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("key"), "group", "n")
        for key in ("subtype", "source")
    ]
    return sel.union_groups(parts)


@REGISTRY.query("""WITH g AS (SELECT source, count(*) AS n,
    CASE WHEN min(doc_id) % 2 = 0 THEN concat('zip-', source) END AS archive FROM documents GROUP BY source)
  SELECT source AS "group", coalesce(archive, 'docs') AS archive,
    CASE WHEN archive IS NULL THEN 'whole' END AS archive_folder,
    CASE WHEN archive IS NULL THEN 'docs' ELSE concat('meta-', source) END AS metadata FROM g""")
def dataset_defaults(spark, sf_dir):
    own = F.when(F.min("doc_id") % 2 == 0, F.concat(F.lit("zip-"), F.col("source")))
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(own.alias("archive"))
    groups = groups.select(
        F.col("source").alias("group"), "archive", F.lit(None).cast("string").alias("archive_folder"),
        F.when(F.col("archive").isNotNull(), F.concat(F.lit("meta-"), F.col("source"))).alias("metadata"),
    )
    return sel.with_dataset(groups, DATASET)


@REGISTRY.query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat('own/', source, '-', doc_id, '.fa')
  WHEN doc_id % 3 = 1 THEN concat('whole/', doc_id, '.fasta') ELSE concat(doc_id, '.fasta') END AS member FROM documents""")
def member_paths(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.format_string("own/%s-%s.fa", "source", "doc_id")).alias("filename"),
        F.when(F.col("doc_id") % 3 == 1, F.lit("whole")).alias("archive_folder"),
    )
    return sel.resolve_member(ids).select("id", "member")


@REGISTRY.query("""SELECT doc_id AS id, p AS part, CASE WHEN doc_id % 4 = 0 THEN concat(doc_id, '-', p, '.fa')
  ELSE concat(doc_id, '.fasta') END AS member FROM documents, (VALUES (0), (1), (2)) v(p)
  WHERE p = 0 OR (doc_id % 4 = 0 AND p <= 2)""")
def member_lists(spark, sf_dir):
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.concat("doc_id", F.lit("-"), p, F.lit(".fa")))
    ids = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, parts).alias("filenames")
    )
    return sel.explode_members(ids).select("id", "part", "member")


@REGISTRY.query(f"""WITH {META} SELECT id, g AS "group", sample_no, concat(lpad(CAST(sample_no AS VARCHAR), 10, '0'), '.fasta') AS filename
  FROM (SELECT id, g, row_number() OVER (ORDER BY g, entry_no) AS sample_no FROM meta JOIN grps ON g = subtype)""")
def numbered_samples(spark, sf_dir):
    picked = sel.pick_group(metadata(spark, sf_dir), _groups(spark, sf_dir), "subtype")
    return sel.number_samples(picked).select("id", "group", "sample_no", "filename")


@REGISTRY.query(f"""WITH {META} SELECT id, g AS "group", entry_no, row_number() OVER (ORDER BY g, entry_no) AS sample_no
  FROM (SELECT id, subtype, (id * 2654435761 + 12345) % 1000000007 * 4000037 AS entry_no FROM meta) JOIN grps ON g = subtype""")
def numbered_scattered_samples(spark, sf_dir):
    """Numbers of entries whose own numbers are scattered over a wide range, as hashes are."""
    entries = metadata(spark, sf_dir).withColumn("entry_no", (F.col("id") * 2654435761 + 12345) % 1000000007 * 4000037)
    picked = sel.pick_group(entries, _groups(spark, sf_dir), "subtype")
    return sel.number_samples(picked).select("id", "group", "entry_no", "sample_no")


@REGISTRY.query(f"""WITH {META} SELECT m.id, m.subtype AS "group", s.n FROM meta m
  JOIN (SELECT subtype, count(*) AS n FROM meta GROUP BY subtype) s USING (subtype)""")
def entries_with_group_options(spark, sf_dir):
    entries = sel.label_by(metadata(spark, sf_dir), "subtype").select("id", "group")
    options = entries.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return sel.with_group_options(entries, options).select("id", "group", "n")


@REGISTRY.query("""SELECT doc_id AS sample_id, concat('lang-k=', k, '-mode=', m) AS experiment,
  concat('lang-k=2-mode=', m) AS selection, k, m AS mode, 3 AS folds
  FROM documents, (VALUES (2), (3), (4)) ks(k), (VALUES ('counts'), ('frequencies')) ms(m)""")
def experiment_grid_samples(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"))
    return experiment_grid(
        ids, "lang", {"k": "2..4", "mode": ["counts", "frequencies"]}, fixed={"folds": 3}, copy_for=["k"]
    )


def _archives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("text"))
    return docs.select(
        F.lit("docs").alias("archive"), F.concat(F.lit("whole/"), "doc_id", F.lit(".fasta")).alias("member"),
        content.alias("content"),
    )


@REGISTRY.query(f"""WITH {META} SELECT id, "group", concat(lpad(CAST(sample_no AS VARCHAR), 10, '0'), '.fasta') AS filename,
  regexp_replace(text, '[^ACGT]', '', 'g') AS seq FROM (
    SELECT id, text, g AS "group", row_number() OVER (ORDER BY g, entry_no) AS sample_no
    FROM meta JOIN grps ON g = subtype WHERE NOT recombinant)""")
def selection_step(spark, sf_dir):
    groups = sel.with_dataset(_groups(spark, sf_dir), DATASET).withColumnRenamed("metadata", "metadata_name")
    kept = sel.exclude_flagged(metadata(spark, sf_dir), "recombinant", include=False)
    picked = sel.pick_group(kept, groups, "subtype")
    out = select_sequences(picked, _archives(spark, sf_dir))
    return out.select("id", "group", "filename", F.array_join("sequences", "|").alias("seq"))


@REGISTRY.query(f"""WITH {META},
  halves AS (SELECT g, entry_no, id, 0 AS part_no, regexp_replace(text, '[^ACGT]', '', 'g') AS seq FROM meta JOIN grps ON g = subtype
    UNION ALL SELECT g, entry_no, id, 1, regexp_replace(reverse(text), '[^ACGT]', '', 'g') FROM meta JOIN grps ON g = subtype)
  SELECT id, g AS "group", part_no, seq, row_number() OVER (ORDER BY g, entry_no, part_no) AS sample_no FROM halves""")
def selection_with_postprocess(spark, sf_dir):
    groups = sel.with_dataset(_groups(spark, sf_dir), {"archive": "docs", "metadata": "docs"})
    groups = groups.drop("metadata")
    files = F.array(F.concat("id", F.lit("-fwd.fa")), F.concat("id", F.lit("-rev.fa")))
    picked = sel.pick_group(metadata(spark, sf_dir), groups, "subtype").withColumn("filenames", files)
    docs = table(spark, sf_dir, "documents")
    archives = docs.select(
        F.lit("docs").alias("archive"),
        F.explode(
            F.array(
                F.struct(F.concat("doc_id", F.lit("-fwd.fa")).alias("member"), F.col("text").alias("content")),
                F.struct(F.concat("doc_id", F.lit("-rev.fa")).alias("member"), F.reverse("text").alias("content")),
            )
        ).alias("f"),
    ).select("archive", "f.*")

    def one_sample_per_file(entries):
        return entries.select("id", "group", "entry_no", F.posexplode("file_sequences").alias("part_no", "sequences"))

    out = select_sequences(picked, archives, one_sample_per_file)
    return out.select("id", "group", "part_no", F.array_join("sequences", "").alias("seq"), "sample_no")
