"""Base scores and counts by hand; the tree's distributions sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import lm
from tabulon.llm import textops as T
from tabulon.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_scores(spark, small):
    rows = {r["doc_id"]: r["text"] for r in small.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    c = Counter()
    for i, t in rows.items():
        if not held[i]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    got = QUERIES["op5_lm_scores"](spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [*words(rows[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] < 0


def test_contexts_pay_on_unseen_text(small):
    """Held-out text is likelier by the tree than by its root, and by contexts of five bytes than
    by those of two. It isn't compared with the base, which isn't a distribution: any number of
    new words get half a count each, while the tree must spell them.
    """
    docs = small.select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    new = docs.filter("held_out")
    total = lambda model: sum(r["score"] for r in lm.score(new, model).collect())
    model = lm.train(docs.filter("not held_out"))
    whole, tree = total(model), model["tree"]
    short = total(model | {"tree": tree | {"levels": tree["levels"][:2]}})
    root = total(model | {"tree": tree | {"levels": []}})
    assert whole > 0.95 * short > 0.7 * root


def test_tree_sums_to_one(small):
    tree = lm.train(small)["tree"]
    rng = np.random.default_rng(0)
    texts = [r["text"] for r in small.filter("text is not null").limit(20).collect()]
    import pyarrow as pa

    buf, off = T.texts(pa.array(texts))
    starts, _, before = T.spans(buf, off, T.IS_WS)
    g = lm.grams(*lm.stream(buf, off, starts, before))
    for x in rng.choice(g, 40):
        after = (x & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert (10 ** lm.log_probabilities(tree, after)).sum() == pytest.approx(1, abs=1e-6)
    assert len(tree["levels"][2][0]) > 0


def test_edges(edges, nothing):
    d = edges.select("doc_id", "text", "kept")
    model = lm.train(d)
    out = lm.score(d, model)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == d.count() and "kept" in out.columns
    assert all(by[i]["n_tokens"] == 1 and by[i]["n_known"] == 1 for i in (1, 2, 3)) and by[8]["n_tokens"] == 60_001
    assert by[1]["score"] == pytest.approx(by[2]["score"]) == pytest.approx(by[3]["score"]) and lm.score(nothing.select("doc_id", "text"), model).count() == 0
    none = lm.train(nothing.select("doc_id", "text"))
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in lm.score(d, none).collect())
