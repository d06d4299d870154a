"""The registered queries against SQL, and the pipeline against plain versions."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from fieldstats.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.cases import frame, texts, words
from tests.llm.test_operators import _jaccard_groups

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_language_of_held_out_documents(spark):
    langs = dict(connect(SF_DIR).execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in QUERIES["op8_language_ppm"](spark, SF_DIR).collect() if r.held_out and r.lang_pred != "und"]
    assert len(got) > 20 and sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.97 * len(got)


def test_stages(spark):
    rows = texts()
    docs = frame(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    spoken = stage["language_id"](spark, docs, "")
    assert spoken.columns == docs.columns
    assert Counter(r.doc_id for r in spoken.collect()) == Counter(
        i for i, text, *_ in rows if any(c.isalpha() for c in text or "")
    )
    lines = stage["line_dedup"](spark, docs, "")
    assert lines.columns == docs.columns and lines.count() == len(rows)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in lines.collect())
    _, groups = _jaccard_groups(rows, 5, 80, 100)
    near = stage["ngram_jaccard_join"](spark, docs, "")
    assert Counter(r.doc_id for r in near.collect()) == Counter(i for i, *_ in rows if i is None or groups.root(i) == i)
    mixed = stage["source_mixing"](spark, docs, "")
    sizes, taken = Counter(), Counter()
    for _, text, _, source in {r: 1 for r in rows}:
        sizes[source] += len(words(text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    assert mixed.columns == docs.columns
    assert abs(sum(taken.values()) - 1.5 * sum(len(words(r[1])) for r in rows)) < 12


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_run(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    bins = packed.groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in bins)
    assert max(r[1] for r in bins) <= 4_096 and len(bins) == -(-total // 4_096)
