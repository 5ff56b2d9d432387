"""Coded blocks decode to their ids; files read back whole, and damage is found."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import rangecoder as R
from tabulon.llm import tokenfile as F
from tabulon.llm import tokens
from tabulon.llm.blobs import Ranges
from tabulon.llm.shared import vocabulary


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), min_size=1, max_size=300), min_size=1, max_size=4), st.integers(0, 3))
def test_blocks(parts, few):
    blocks = sorted(((np.array(p) % (1 << (4 * few) if few else 65536)).astype(np.uint16) for p in parts), key=len, reverse=True)
    coded = R.encode_blocks(blocks)
    back = R.decode_blocks(coded, np.array([len(b) for b in blocks]))
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_full_blocks():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.3, R.BLOCK).astype(np.uint16), np.zeros(R.BLOCK, np.uint16), np.arange(R.BLOCK, dtype=np.uint16), rng.integers(0, 65536, 777).astype(np.uint16)]
    coded = R.encode_blocks(blocks)
    assert len(coded[0]) < 2 * R.BLOCK and len(coded[1]) < 200
    for a, b in zip(blocks, R.decode_blocks(coded, np.array([len(x) for x in blocks])), strict=True):
        assert (a == b).all()
    alone = R.encode_blocks(blocks[2:3])
    assert alone[0] == coded[2]  # a block doesn't depend on its neighbours


def check(df):
    enc = tokens.encoder(tokens.ByteIds, vocabulary("byte_bpe_50k.json")).tok
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*enc.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, F.round_trip(df).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str) == sorted(want, key=str)


def test_small_table(small):
    check(small)


def test_edges(edges, nothing):
    check(edges)
    assert F.round_trip(nothing).count() == 0


def test_large_ids():
    with pytest.raises(ValueError):
        list(F.Writer().add(1, np.array([65536], np.uint32)))


def test_damage(tmp_path):
    w = F.Writer()
    parts = [w.begin()]
    for i in range(20):
        parts += list(w.add(i, np.arange(i * 40, dtype=np.uint16)))
    parts += list(w.end())
    raw = b"".join(p + b"\n" for p in parts)
    path = tmp_path / "x"
    path.write_bytes(raw)
    docs = list(F.read_documents(Ranges(str(path))))
    assert [(i, len(x)) for i, x in docs] == [(i, i * 40) for i in range(20)]
    path.write_bytes(raw[:12] + bytes([raw[12] ^ 255]) + raw[13:])
    with pytest.raises(ValueError):
        list(F.read_documents(Ranges(str(path))))
    path.write_bytes(raw[:-60] + bytes([raw[-60] ^ 1]) + raw[-59:])
    with pytest.raises(ValueError):
        list(F.read_documents(Ranges(str(path))))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.integers(0, 70))
def test_find_in_rows(seed, n, kinds):
    rng = np.random.default_rng(seed)
    model = R._Model(n)
    model.kinds[:] = rng.integers(0, kinds + 1, n)
    for k in range(n):
        model.counts[k, : model.kinds[k]] = rng.integers(1, 50, model.kinds[k])
    model.sums(n)
    for k in range(n):
        sums = model.cum[k, : model.known[k] + 1]
        assert sums[-1] == model.total[k] == model.counts[k].sum()
        v = np.arange(int(model.total[k]))
        at = np.full(len(v), k)
        got = model.find(at * model.width, v + (at << R._ROW)) - at * model.width
        assert (got == np.searchsorted(sums, v, "right") - 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 65535), min_size=1, max_size=200, unique=True), st.integers(0, 2**32 - 1))
def test_heads(ids, seed):
    ids, counts = np.sort(ids), np.random.default_rng(seed).integers(1, 20, len(ids))
    raw = R._head(ids, counts)
    got, n, size = R._read_head(raw + b"rest")
    assert (got == ids).all() and (n == counts).all() and size == len(raw)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_damaged_blocks_end(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.zipf(1.3, n).astype(np.uint16) for n in (700, 90, 1)]
    coded = [bytearray(x) for x in R.encode_blocks(blocks)]
    for x in coded:
        x[rng.integers(len(x))] ^= int(rng.integers(1, 256))
    try:
        back = R.decode_blocks([bytes(x) for x in coded], np.array([len(b) for b in blocks]))
    except ValueError:
        return
    assert [len(x) for x in back] == [700, 90, 1]  # the file's checksums tell that they differ


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["word", "Wört", "É", "×", "÷a", "ß", ",", "%%", "'s", "7", "\n", "\n\n", " ", "\xa0", "\x85", "漢", "a,b", "<|x"]), max_size=12).map("".join), max_size=4))
def test_texts_by_parts(texts):
    enc = tokens.encoder(tokens.ByteIds, vocabulary("byte_bpe_50k.json"))
    want = [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode([t.encode() for t in texts]) == want


def test_words_begin_anew(monkeypatch):
    enc = tokens.ByteIds(vocabulary("byte_bpe_50k.json"))
    texts = [b"to be, or not", b"to be! \xc3\x89t\xc3\xa9 broken \xc3 bytes\xff", b"", b"not or.\n\xc3\x89t\xc3\xa9 be"]
    want = [enc.whole(t) for t in texts]
    monkeypatch.setattr(tokens, "WORDS", 2)
    for _ in range(3):
        assert [enc.encode([t])[0] for t in texts] == want and enc.encode(texts) == want


def test_seconds():
    """CPU seconds to code and decode, in those of a plain loop, so that slow machines pass."""
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.2, 1024).astype(np.uint16) for _ in range(768)]

    def timed(f):
        t = time.thread_time()
        f()
        return time.thread_time() - t

    loop = min(timed(lambda: sum(range(1_000_000))) for _ in range(5))
    assert min(timed(lambda: R.decode_blocks(R.encode_blocks(blocks), np.full(768, 1024))) for _ in range(3)) < 35 * loop  # 57 before, 19 since
