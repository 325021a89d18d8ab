"""The pipeline: each stage on the rows that its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from waymark.llm import registry
from waymark.llm._common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.select("doc_id").distinct().count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.5 * counts[0]


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"empty-{name}")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    assert set(registry.oracle_sql()) <= names
