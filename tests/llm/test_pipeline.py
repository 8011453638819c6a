"""The whole pipeline against its stages written out plainly."""

import hashlib
import os

import pytest
from corpus_helpers import empty, odd_documents
from test_filters import plain_contamination
from test_simhash import plain_components, plain_jaccard

import corpus_pipeline
from staffline.llm import quality, toxicity
from staffline.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages_keep_what_they_should(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    weights = toxicity.WordWeights(model)
    left = [r for r in docs.collect() if toxicity.document_score(r.text or "", weights) < 0.5]
    judged, names = quality.judge(spark.createDataFrame(left, docs.schema), quality.fit(spark.createDataFrame(left, docs.schema), labels))
    good = {r.doc_id for r in judged.where(names[-1]).collect()}
    left = [r for r in left if r.doc_id in good]
    groups = plain_components({r.doc_id: r.text or "" for r in left}, lambda a, b: plain_jaccard(a, b) >= 0.8)
    left = [r for r in left if groups[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {p[0] for p in plain_contamination([(r.doc_id, r.text) for r in left], items) if p[-1]}
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left if r.doc_id not in dirty)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want
    assert 0 < len(want) < docs.count()


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = table(spark, SF, "documents").limit(60)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_on_odd_rows_and_on_an_empty_table(spark):
    """Null and repeated ids, null, empty and long texts and clashing columns go through every stage; nothing comes of nothing."""
    odd = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        found = out.collect()
        assert len(found) <= odd.count() and (name == "byte_bpe" or out.columns == odd.columns), name
        assert stage(spark, empty(odd), SF).collect() == [], name
