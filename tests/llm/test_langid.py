"""Forward sums against all segmentations; accuracy on documents that weren't learned from."""

import os

import numpy as np
import pytest

from tabulon.llm import langid as L
from tabulon.llm.queries import QUERIES


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


def by_hand(word, p_of):
    """The sum over all segmentations, by dynamic programming over every substring."""
    a = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        a[j] = sum(a[i] * p_of.get(word[i:j], 0.0) for i in range(j))
    return np.log(a[-1])


def test_forward_and_expected():
    pieces = sorted([b"a", b"b", b" ", b"ab", b" a", b"ba", b" ab"])
    lattice = L.Lattice(pieces)
    p = np.r_[np.linspace(0.05, 0.3, len(pieces)), 0.0]
    words = np.frombuffer(b" aba abb", np.uint8).reshape(2, 4)
    got = np.exp(lattice.forward(words, np.array([4, 4]), p[:, None])[:, 0])
    expected = np.zeros(len(pieces) + 1)
    for k, w in enumerate((b" aba", b" abb")):
        ways = [(np.prod([p[pieces.index(x)] for x in s]), s) for s in segmentations(w) if all(x in pieces for x in s)]
        assert got[k] == pytest.approx(sum(x for x, _ in ways))
        for x, s in ways:
            for y in s:
                expected[pieces.index(y)] += (k + 1) * x / got[k]
    assert lattice.expected(words, np.array([1, 2]), p) == pytest.approx(expected)
    one = [lattice.expected(words[k : k + 1], np.array([k + 1]), p) for k in (0, 1)]
    assert one[0] + one[1] == pytest.approx(expected)


@pytest.mark.parametrize("sizes", [(40,), (100,), (40, 41, 100, 100, 37), (600,), (5, 513, 700)])
def test_whole_runs(sizes):
    """Runs of any length are scored whole, alone and beside others."""
    rng = np.random.default_rng(len(sizes))
    pieces = sorted({*(bytes([b]) for b in range(256)), b" a", b"ab", b"abc", b"bc", b"ca", b"abcabcabcabcabcabcabcab"})
    lattice = L.Lattice(pieces)
    p = rng.random((len(pieces) + 1, 2))
    p[-1] = 0
    p /= p.sum(0)
    words = [bytes(rng.choice(np.frombuffer(b"abc", np.uint8), n)) if n % 2 else (b"abc" * n)[:n] for n in sizes]
    ends = np.cumsum(sizes)
    got = np.zeros((len(sizes), 2))
    for at, m, n in L.matrices(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends):
        got[at] = lattice.forward(m, n, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(by_hand(b" " + w, dict(zip(pieces, p[:, k], strict=False))) if len(w) < 200 else lattice._forward_one(np.frombuffer(b" " + w, np.uint8)[None], p)[0, k], rel=1e-9)


def test_groups_of_languages(spark, edges, monkeypatch):
    """Languages scored one at a time give what all at once give."""
    model = L.train(edges)
    rows = lambda: {(r["doc_id"], r["source"]): (r["lang_pred"], round(r["score"], 9)) for r in L.identify(edges, model).collect()}
    whole = rows()
    monkeypatch.setattr(L, "GROUP", 1)
    assert rows() == whole


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, d).join(docs, "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, edges, nothing):
    model = L.train(edges)
    out = L.identify(edges, model)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*edges.columns, "lang_pred", "score"] and out.count() == edges.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3)) and by[6]["lang_pred"] == "xx" and by[9]["lang_pred"] in ("xx", "yy")
    empty = L.train(nothing)
    assert {r["lang_pred"] for r in L.identify(edges, empty).collect()} == {"und"} and L.identify(nothing, model).count() == 0
    digits = spark.createDataFrame([(1, "123 --- 45"), (2, "漢字")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in L.identify(digits, model).orderBy("doc_id").collect()] == [True, False]
