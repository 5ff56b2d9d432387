"""Statistics by regular expressions; models by hand; bands that reject noise."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import quality as Q


def by_hand(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(df):
    texts: dict = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"])
    out = Q.judge(df).collect()
    for r in out:
        want = by_hand(texts[r["doc_id"]])
        assert tuple(r[f] for f in FIELDS) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    return out


def test_small_table(small):
    out = check(small)
    sound = [r for r in out if not r["base_failed"]]
    assert np.mean([r["kept"] for r in sound]) > 0.9


def junk_of(texts):
    """Random marks, random letters, and the letters of a sound text in random order."""
    rng = np.random.default_rng(5)
    spaced = lambda x: " ".join("".join(x)[i : i + 8] for i in range(0, len(x), 8))
    marks, letters = ([chr(c) for c in rng.integers(lo, hi, 4000)] for lo, hi in ((33, 126), (97, 123)))
    shuffled = [*max(texts, key=len).replace(" ", "")]
    rng.shuffle(shuffled)
    return [spaced(marks), spaced(letters), spaced(shuffled)]


def test_junk_goes(spark, small):
    """The registered bands reject noise that is in the corpus the models are of, and keep
    nearly all others."""
    d = small.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    texts: dict = {}
    for r in d.collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    junk = [(10_000_000 + 10 * i + k, t, lang) for i, lang in enumerate(texts) for k, t in enumerate(junk_of(texts[lang]))]
    out = Q.judge(d.union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))).collect()
    new = [r for r in out if r["doc_id"] >= 10_000_000]
    sound = [r for r in out if r["doc_id"] < 10_000_000 and not r["base_failed"]]
    assert len(new) == len(junk) and not any(r["kept"] or r["base_failed"] for r in new)
    assert np.mean([r["kept"] for r in sound]) >= 0.95


def test_edges(edges, nothing):
    out = check(edges)
    assert len(out) == edges.count() and all(r["base_failed"] for r in out if r["doc_id"] in (1, 2, 3, 4, 5, 8))
    assert Q.judge(nothing).count() == 0


def kneser_ney_by_hand(texts):
    """p(symbol, the symbols before it) from counts in dictionaries."""
    n = Q.ORDER
    symbol = lambda ch: " " if ch in " \t\n\v\f\r" else "0" if ch in "0123456789" else ch.lower() if ch.isascii() else ch
    counts = [Counter() for _ in range(n)]
    for t in texts:
        x = ["START"] * (n - 1) + [symbol(ch) for ch in t]
        counts[-1].update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k - 1].update(g[1:] for g in counts[k])
    off = [Q.discounts(*(sum(c == k for c in level.values()) for k in (1, 2, 3, 4))) for level in counts]
    after = lambda k, c: c - min(off[k][min(c, 3)], 0.9 * c)

    def p(x):
        if not x:
            return 1 / 4096
        level = counts[len(x) - 1]
        total = sum(c for g, c in level.items() if g[:-1] == x[:-1])
        if not total:
            return p(x[1:])
        kept = sum(after(len(x) - 1, c) for g, c in level.items() if g[:-1] == x[:-1])
        return (after(len(x) - 1, level[x]) if x in level else 0) / total + (1 - kept / total) * p(x[1:])

    return lambda before, ch: p(tuple((["START"] * n + [symbol(c) for c in before])[-(n - 1) :] + [symbol(ch)]))


def test_kneser_ney_by_hand(spark):
    """Each text by the model of the other fold's texts, in Latin and other scripts."""
    texts = ["An apple and 12 ants, an apple.", "Привет, мир и мирный мир", "猫が好き。猫は好き。", "and an ant ate an apple and", "мир и мирный привет", "好きな猫が", "a", "an apple 🙂 ant"]
    d = spark.createDataFrame([(i, t, "xx") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_ppl"] for r in Q.measure(d, Q.fit(Q.count_ngrams(d))).collect()}
    fold = {r["doc_id"]: r["fold"] for r in Q.with_fold(d).collect()}
    assert set(fold.values()) == {0, 1} and got[0] == got[8]
    for f in (0, 1):
        p = kneser_ney_by_hand([t for i, t in enumerate(texts) if fold[i] != f])
        for i, t in enumerate(texts):
            if fold[i] == f:
                assert got[i] == pytest.approx(np.mean([-np.log(p(t[:k], t[k])) for k in range(len(t))]), rel=1e-6), t


def test_sums(spark, small):
    """Probabilities of all symbols after a context sum to one, rare n-grams kept or not."""
    d = small.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    name = Q.model_name([d.first()["lang"]], [0])[0]
    buf, off = Q.T.texts(pa.array([r["text"] for r in d.limit(5).collect()]))
    code = Q.codes(*Q.symbols(buf, off))
    for share in (0.0, 1e-3):
        m = Q.Model.read(Q.fit(Q.count_ngrams(d), share), name)
        for g in code[[3, 100, 1000]]:
            assert m.probabilities((g >> 12 << 12) + np.arange(4096)).sum() == pytest.approx(1, abs=1e-9)


def test_copies_leave_bands_alone(spark, small):
    """Copies of one text that are two thirds of a language change neither its model nor its
    band; near copies that are most of it leave a band too."""
    lang = small.filter("lang is not null").groupBy("lang").count().orderBy("count", ascending=False).first()["lang"]
    own = small.filter(f"lang = '{lang}' and text is not null").select("doc_id", "text", "lang").dropDuplicates(["text"]).collect()
    text = max((r["text"] for r in own), key=len)
    same = [(1_000_000 + i, text, lang) for i in range(2 * len(own))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = {r["doc_id"]: r for r in Q.judge(frame(own)).collect()}
    beside = {r["doc_id"]: r for r in Q.judge(frame([*map(tuple, own), *same])).collect()}
    for i, r in alone.items():
        assert beside[i]["kept"] == r["kept"] and beside[i]["log_ppl"] == pytest.approx(r["log_ppl"]) and beside[i]["highest"] == pytest.approx(r["highest"])
    near = [(1_000_000 + i, f"{text} {i}", lang) for i in range(2 * len(own))]
    beside = Q.judge(frame([*map(tuple, own), *near])).first()
    assert beside["highest"] - beside["lowest"] >= (Q.BELOW + Q.ABOVE) * Q.SPREAD - 1e-9


def gram(text):
    return sum(ord(ch) << (Q.BITS * k) for k, ch in enumerate(reversed(text)))


def test_rare_ngrams_count(spark):
    """An n-gram seen once among twenty million others has its share, as when nothing is rare."""
    for often in (20, 20_000_000):
        d = spark.createDataFrame([("m", gram("aaaaa"), often), ("m", gram("bcdef"), 1)], "model string, g long, raw long")
        p = Q.Model.read(Q.fit(d), "m").probabilities(np.array([gram("bcdef")]))[0]
        # of each context's one n-gram nine tenths are taken off at most, and go to the order below
        assert p > 0.1, often


def test_parts(spark, small):
    """A model in many parts, of which few are held, gives what it gives in one."""
    d = small.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    name, counts = Q.model_name([d.first()["lang"]], [0])[0], Q.count_ngrams(d)
    buf, off = Q.T.texts(pa.array([r["text"] for r in d.limit(20).collect()]))
    grams = np.unique(np.r_[Q.codes(*Q.symbols(buf, off)), np.arange(5000)])
    one, many = Q.Model.read(Q.fit(counts), name), Q.Model.read(Q.fit(counts, part=1000), name, Q.Held(50_000))
    assert one.parts == 1 and many.parts > 5
    for _ in range(2):
        assert (many.probabilities(grams) == one.probabilities(grams)).all()
        assert 1 <= len(many.held.parts) < many.parts
