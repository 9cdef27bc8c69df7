"""Every stage over the given documents: columns, kept rows, and what each decision must change."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from repoloom.llm.common import stored, table
from repoloom.llm.decontaminate import contamination_report
from repoloom.llm.secrets import secrets_report

from test_simhash import kept_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append((name, docs))
    return dict(out)


def test_columns_and_rows(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    before = None
    for name in ["documents", *names[:-1]]:
        df = steps[name]
        assert df.dtypes == steps["documents"].dtypes
        ids = [r.doc_id for r in df.collect()]
        assert len(ids) == len(set(ids)) and (before is None or set(ids) <= before)
        before = set(ids)


def test_quality_follows_the_labels(spark, steps):
    kept = {r.doc_id for r in steps["quality"].collect()}
    rows = [(r.doc_id in kept, r.quality) for r in table(spark, SF, "labels").collect()]
    assert sum(k == q for k, q in rows) > 0.95 * len(rows)


def test_copies_go(steps):
    before = {}
    for r in steps["quality"].collect():
        before.setdefault(r.text, []).append(r.doc_id)
    kept = {r.doc_id for r in steps["near_duplicates"].collect()}
    for ids in before.values():
        assert len(kept & set(ids)) <= 1

    assert sorted(((r.doc_id, r.text) for r in steps["near_duplicates"].collect()), key=repr) == kept_by_hand(steps["quality"].collect())


def test_nothing_is_left_to_find(spark, steps):
    left = contamination_report(steps["decontamination"], table(spark, SF, "benchmark"))
    assert left.where("n_hit > 0").count() == 0
    assert secrets_report(steps["secrets"]).where("spans <> ''").count() == 0
    for r in steps["secrets"].collect():
        assert r.text is None or r.n_chars == len(r.text)
        assert not re.search("AKIA[A-Z0-9]{14}", r.text or "")


def test_packing_has_every_kept_document(steps):
    ids = {r.doc_id for r in steps["packing"].collect()}
    assert ids == {r.doc_id for r in steps["secrets"].collect()}


def test_run_and_odd_rows(spark, make_docs, odd_texts, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps["packing"].count()
    docs = make_docs(odd_texts).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() > 0, name
    empty = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
