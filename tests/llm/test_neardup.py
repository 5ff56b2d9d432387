"""Near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import neardup as N
from tabulon.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i][0]), find(i)) for i in ids}


def got(df, width):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, width).collect()}


def test_parities():
    """Parities differ in no more places than two sets do in elements, and nearly as many."""
    rng = np.random.default_rng(4)
    for n, cut in ((380, 60), (50, 3), (2000, 300), (7, 7)):
        x = rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)
        a, b = x[cut:], x[: n - cut // 2]
        apart = int(np.bitwise_count((N.parities(a) ^ N.parities(b)).view(np.uint64)).sum())
        truly = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.6 * truly <= apart <= truly


@pytest.mark.parametrize("width", [2, 5])
def test_small_table(small, width):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert got(small, width) == brute(rows, width)


def test_chains_and_groups(spark):
    """Chains of neighbours at the threshold, a large group of near copies, and a hot word pair."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for step in range(12):
            t = list(base)
            for _ in range(step):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(60):
        t = list(base)
        t[rng.randrange(80)] = rng.choice(words)
        rows.append((n, " ".join(t)))
        n += 1
    rows += [(n + i, f"the same words {i}") for i in range(40)] + [(n + 50 + i, "exact copy of five words") for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df, 2) == brute(rows, 2)


def test_edges(edges, nothing):
    out = N.near_duplicates(edges, 2).collect()
    assert len(out) == edges.count() and [c for c in N.near_duplicates(edges).columns] == ["doc_id", "n_shingles", "component_id", "kept"]
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (1, 2, 3))
    assert by[4]["n_shingles"] == 1 and by[8]["n_shingles"] == 1 and by[9]["n_shingles"] == 1
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert N.near_duplicates(nothing).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:3000])
    ra, rb, ru = N.registers([a, b, np.sort(pool)])
    assert (np.maximum(ra, rb) == ru).all()
    j = N.estimate(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1 / 3) < 0.15


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 50)] + [(100, 102), (102, 101), (5, 5), (7, 3)], "a long, b long")
    c = {r["node"]: r["component"] for r in components(e).collect()}
    assert c == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
    assert components(e.filter(F.lit(False))).count() == 0
