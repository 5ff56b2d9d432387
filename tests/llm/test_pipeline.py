"""Each stage on what the one before kept."""

import corpus_pipeline
from tabulon.llm import linededup, neardup
from tabulon.llm.shared import written
from tests.llm.conftest import SMALL


def test_stages(spark, small):
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        out = written(stage(spark, docs, SMALL), "t")
        if name != "pack":
            assert out.columns == small.columns and dict(out.dtypes) == dict(small.dtypes)
        if name in ("language", "lines", "near-duplicates"):
            assert out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    whole = small.filter("text is not null and lang is not null and length(text) > 200")
    assert len(ids(whole) - ids(seen["lines"])) <= 0.05 * whole.count()
    removed = linededup.dedup_lines(seen["lines"]).filter("n_removed > 0")
    assert removed.count() > 0
    left = neardup.near_duplicates(seen["mix"], width=corpus_pipeline.WIDTH)
    assert left.filter("not kept").count() == 0
    pieces = docs.groupBy("doc_id", "start").count()
    assert pieces.count() > 0 and ids(docs) <= ids(seen["mix"])


def test_edges(spark, edges, nothing):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (edges.select(cols), nothing.select(cols)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), "t")
        assert (docs.count() == 0) == (start.count() == 0)
