"""Null ids and names, repeated rows, clashing extra columns and empty tables: the results that the docstrings define."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigloom.llm import (
    exact_dedup, jaccard_join, language_model, license_scan, mixing, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup,
)
from sigloom.llm.sketch import Sketch

SMALL = Sketch(rows=1, bits=18)
JOIN = jaccard_join.Settings(corpus=Sketch(rows=1, bits=20), candidates=Sketch(rows=1, bits=18))

OPERATORS = {
    "exact": lambda d, m: exact_dedup.exact_dedup(d),
    "language": lambda d, m: language_model.held_out_scores(d),
    "license": lambda d, m: license_scan.license_scan(d),
    "substring": lambda d, m: substring_dedup.substring_dedup(d, 20, SMALL),
    "suffix": lambda d, m: suffix_dedup.suffix_dedup(d, suffix_dedup.Settings(width=40, gram=10, sketch=SMALL)),
    "jaccard": lambda d, m: jaccard_join.jaccard_join(d, JOIN),
    "rules": lambda d, m: quality_rules.quality_rules(d, quality_rules.fit(d, m)),
    "mixing": lambda d, m: mixing.mix(d),
    "classifier": lambda d, m: quality_classifier.quality_scores(d, quality_classifier.fit(d, m)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd_docs, marks, name):
    found = OPERATORS[name](odd_docs, marks).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_docs.select("doc_id").collect())
    twins = [tuple(r) for r in found if r.doc_id == 7]
    assert len(twins) == 3 and len(set(twins)) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(no_docs, marks, name):
    assert OPERATORS[name](no_docs, marks).count() == 0
    assert OPERATORS[name](no_docs, marks.limit(0)).count() == 0


def test_packing_edges(odd_docs, no_docs):
    found = packing.pack(odd_docs, capacity=128).collect()
    rows = Counter(r.doc_id for r in odd_docs.select("doc_id").collect())
    assert Counter(r.doc_id for r in found if r.start == 0) == rows
    assert packing.pack(no_docs).count() == 0


def test_null_ids_rank_last(odd_docs):
    exact = exact_dedup.exact_dedup(odd_docs).collect()
    first = next(r for r in exact if r.doc_id == 0)
    copies = [r for r in exact if r.text_sha256 == first.text_sha256]
    assert None in {r.doc_id for r in copies} and {r.keep_id for r in copies} == {first.keep_id} and first.keep_id is not None
    grouped = jaccard_join.jaccard_join(odd_docs, JOIN).collect()
    alone = [r for r in grouped if r.doc_id is None and r.n_shingles > 0]
    assert {r.component_id for r in alone} >= {None, next(r.component_id for r in grouped if r.doc_id == 0)}


def test_stages_keep_columns_and_drop_repeats(odd_docs, marks):
    for kept in (exact_dedup.survivors(odd_docs), jaccard_join.representatives(odd_docs, JOIN), quality_classifier.accepted(odd_docs, marks), mixing.mixed(odd_docs)):
        assert kept.schema == odd_docs.schema
    assert exact_dedup.survivors(odd_docs).where("doc_id = 7").count() <= 1
    assert jaccard_join.representatives(odd_docs, JOIN).where("doc_id = 7").count() <= 1


def test_untrained_models(docs, marks):
    """No labelled row: the rules keep whatever passes the base, the classifier gives the prior; no training text: probability one."""
    none = marks.limit(0)
    assert quality_rules.quality_rules(docs, quality_rules.fit(docs, none)).where("kept = base_failed").count() == 0
    assert {r.score for r in quality_classifier.quality_scores(docs, quality_classifier.fit(docs, none)).collect()} == {0.5}
    scores = language_model.language_scores(docs, language_model.train(docs.limit(0)))
    assert {r.score for r in scores.collect()} == {0.0}


def test_null_labels_are_ignored(docs, marks):
    more = marks.unionByName(marks.select("doc_id", F.lit(None).cast("int").alias("quality"), "toxic")).unionByName(
        marks.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), "quality", "toxic")
    )
    a, b = (quality_rules.fit(docs, m).threshold for m in (marks, more))
    assert a == b
