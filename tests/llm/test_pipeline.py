"""The registered queries of the text operators, and the pipeline against its own operators."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import decontam, jaccard, pii
from tidewatch.llm.common import cut, table

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith(("op6_", "op8_"))])
def test_small_queries_run(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], SMALL), name))
    rules, near, clean, private, packed = seen[1:]
    assert all(df.columns == docs.columns for df in seen[:-1])
    assert rules.count() < docs.count()
    groups = jaccard.near_duplicates(near)
    assert groups.where("doc_id <> component_id").count() == 0
    lost = near.count()
    assert lost == jaccard.near_duplicates(rules).select("component_id").distinct().count()
    assert decontam.report(clean, table(spark, SMALL, "benchmark")).where("n_hit > 0").count() == 0
    assert private.count() == clean.count() and pii.find(private).where("size(spans) > 0").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in private.select("doc_id").collect()}
