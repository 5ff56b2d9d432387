"""Neighbours against all distances."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ann
from tabulon.llm.queries import QUERIES


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(s), i) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_recall(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    rows = ann.usable(spark.read.parquet(f"{d}/embeddings.parquet")).collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got: dict = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.95
    for q in want:
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        for s, i in got[q]:
            assert s == pytest.approx(float(np.sqrt(((x[ids.index(q)] - x[ids.index(i)]) ** 2).sum())), abs=1e-12)


def test_recall_of_many_lists(spark):
    """50,000 vectors on hundreds of lists, of which a query searches a small part."""
    rng = np.random.default_rng(11)
    spread = rng.normal(size=(400, 24)) * 3
    x = (spread[rng.integers(0, 400, 50_000)] + rng.normal(size=(50_000, 24))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    seen: list = []
    ask = df.filter("vec_id % 200 = 0")
    got: dict = {}
    for r in ann.nearest(df, ask).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 50_000, 200):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(got) == 250 and hit / 2500 >= 0.9
    distinct = df.select(F.col("embedding").cast("array<double>").alias("embedding"), F.col("vec_id").alias("rep"))
    centres = ann.centres_of(distinct, len(x))
    graph = ann.Graph(centres)
    for q in range(0, 50_000, 2000):
        found, dist = graph.search(y[q], ann.BEAM)
        seen.append((dist <= ann.RATIO * dist[0]).sum())
    assert len(centres) > 200 and np.mean(seen) < 0.25 * len(centres)


def test_ties_nulls_copies(spark):
    v = [(i, [1.0, float(i % 3)], "clash") for i in range(40)] + [(100, None, "x"), (101, [0.0, 0.0], "x"), (102, [1.0, None], "x"), (103, [float("nan"), 1.0], "x"), (104, [1.0], "x"), (None, [1.0, 1.0], "x"), (5, [1.0, 2.0], "x")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score string")
    out = ann.nearest(df, df.filter("vec_id in (0, 4, 100, 101)")).orderBy("query_id", "rank").collect()
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in out]
    assert [g for g in got if g[0] == 0] == [(0, i, 0.0) for i in range(3, 33, 3)]
    assert [g[1] for g in got if g[0] == 4] == [1, 7, 10, 13, 16, 19, 22, 25, 28, 31]
    assert {g[0] for g in got} == {0, 4}
    few = df.filter("vec_id in (0, 1, 2)")
    assert [(r["query_id"], r["rank"]) for r in ann.nearest(few, few.filter("vec_id = 1")).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert ann.nearest(df.limit(0), df).count() == 0
