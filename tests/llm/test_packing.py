"""Pieces against whole encodings; sequences without gaps and with little padding."""

import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tabulon.llm import packing as P
from tabulon.llm import tokens
from tabulon.llm.shared import vocabulary


def whole(kind, texts):
    enc = kind(vocabulary("word_bpe_49k.json" if kind is tokens.WordIds else "byte_bpe_50k.json"))
    return [np.array(enc.tok.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted((-1 if i is None else i, zlib.crc32(np.r_[x, 2].astype("<u4").tobytes()), len(x) + 1) for (i, _), x in zip(rows, whole(tokens.WordIds, [t for _, t in rows]), strict=True))
    out = [r.asDict() for r in P.pack(df).collect()]
    assert sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["doc_tokens"]) for r in out}) == sorted({(i, n) for i, _, n in want})
    one = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"], r["length"]) for r in out if r["doc_tokens"] == r["length"])
    assert one == [x for x in want if x[2] <= P.LENGTH]
    by: dict = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= P.LENGTH
    assert sorted(by) == list(range(len(by)))
    total = sum(r["length"] for r in out)
    assert total == sum(n for _, _, n in want)
    return out, total / (len(by) * P.LENGTH)


def test_small_table(small):
    out, fill = check(small)
    assert fill > 0.97
    for r in out:
        assert r["start"] % P.LENGTH == 0 and r["length"] == min(P.LENGTH, r["doc_tokens"] - r["start"])


def test_edges(edges, nothing):
    out, _ = check(edges)
    assert {r["doc_id"]: r["doc_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert P.pack(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_patterns(histogram):
    found = P.patterns(histogram, 64)
    placed: dict = {}
    for lens, n in found:
        assert sum(lens) <= 64 and n > 0
        for x in lens:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    packs = sum(n for _, n in found)
    assert packs <= 2 * max(1, -(-sum(k * v for k, v in histogram.items()) // 64)) or packs <= 2 * sum(v for k, v in histogram.items() if k > 32)


_TEXT = st.text(st.sampled_from("abAB é́ß漢 .,;!?'\n\t0123-_<|endoftext> 🙂"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(_TEXT, min_size=1, max_size=5))
def test_word_ids(texts):
    enc = tokens.encoder(tokens.WordIds, vocabulary("word_bpe_49k.json"))
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(_TEXT, min_size=1, max_size=5))
def test_byte_ids(texts):
    enc = tokens.encoder(tokens.ByteIds, vocabulary("byte_bpe_50k.json"))
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


class _Counts:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tok):
        self.tok, self.n = tok, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.tok.encode_batch_fast(texts, **more)

    def encode(self, text, **more):
        self.n += 1
        return self.tok.encode(text, **more)


def test_marks_are_encoded_once():
    words = [f"{a}{b}{c}" for a in ("an", "rê", "so") for b in ("ber", "çal", "tion") for c in ("ing", "é", "ly")]
    text = " ".join(f"{w}{m}" for w in words for m in ("", ",", "###", "$|", "?!"))
    for kind, name in ((tokens.WordIds, "word_bpe_49k.json"), (tokens.ByteIds, "byte_bpe_50k.json")):
        enc = kind(vocabulary(name))
        plain, enc.tok = enc.tok, _Counts(enc.tok)
        got = enc.encode([text.encode(), b"", text.encode()])
        assert enc.tok.n <= 4 + 6  # the marks, and WordIds' own six or a text's first word
        for t, ids in zip([text, "", text], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


_LATIN = st.text(st.sampled_from("abZÀÿßµª×÷¡'’.,#|~@`_[^3 \n\t\x1cıİ\u0301"), max_size=40)


@settings(max_examples=300, deadline=None)
@example(["ABBA abba, e\u0301", "ABBA\nabba,\nÀ"])
@given(st.lists(_LATIN, max_size=6))
def test_latin_ids(texts):
    for kind, name in ((tokens.WordIds, "word_bpe_49k.json"), (tokens.ByteIds, "byte_bpe_50k.json")):
        enc = tokens.encoder(kind, vocabulary(name))
        for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids
