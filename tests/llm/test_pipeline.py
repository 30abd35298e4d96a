"""The stages in a row against brute-force versions of each on its own input."""

from collections import Counter

import corpus_pipeline
from sigloom.llm import mixing, quality_classifier
from sigloom.llm.common import stored
from tests.llm.test_operators import expect_components, expect_exact


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, marks = docs.schema, spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        out = stored(stage(spark, docs, folder), "stage-test")
        found = out.collect()
        if name == "packing":
            assert Counter(r.doc_id for r in found if r.start == 0) == Counter(r[0] for r in rows)
            filled = Counter()
            for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == filled[r.sequence_id]  # gapless from 0
                filled[r.sequence_id] += r.length
            assert max(filled.values()) <= 4096
            continue
        assert out.schema == schema and set(map(tuple, found)) <= set(rows)
        ids = Counter(r.doc_id for r in found)
        if name == "quality classifier":
            scores = quality_classifier.quality_scores(docs, quality_classifier.fit(docs, marks)).collect()
            assert ids == Counter(r.doc_id for r in scores if r.score >= 0.3)
        elif name == "exact dedup":
            assert ids == Counter(k for k, v in expect_exact(rows).items() if v[2])
        elif name == "n-gram Jaccard join":
            assert ids == Counter(k for k, v in expect_components(rows).items() if v[1] == k)
        elif name == "mixing":
            assert ids == Counter({r.doc_id: r.times for r in mixing.mix(docs).collect() if r.times})
        docs = out


def test_run_and_registry(spark):
    names = [q.name for q in corpus_pipeline.registry()]
    assert len(names) == len(set(names)) == 14 and names[-1] == "pipeline"
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
