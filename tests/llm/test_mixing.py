"""Targets against a water-filling loop; taken words near them and bounded by each document."""

import re

from tabulon.llm import mixing as M


def targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > ceiling * sizes[s]}
        if not over:
            return {**{s: ceiling * sizes[s] for s in full}, **t}
        full |= over


def check(df, slack):
    out = [r.asDict() for r in M.mix(df).collect()]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(words(r["text"]) for r in df.collect())
    by: dict = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    want = targets({s: v[0] for s, v in by.items()})
    for s, (size, taken, told, target) in by.items():
        assert told == size and abs(target - want[s]) <= 1e-5 + 1e-9 * want[s]
        assert abs(taken - target) <= slack + 0.01 * target
    return out


def test_small_table(small):
    a = check(small, 3 * M.BLOCK)
    b = M.mix(small.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_shards(small):
    """A small shard size gives every source many shards, with the same promises."""
    out = M.mix(small, shard_words=2000).collect()
    by: dict = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    for taken, target in by.values():
        assert abs(taken - target) <= 0.05 * target + 40 * M.BLOCK


def by_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_apportion(spark):
    """Seats by the highest quotients, one by one; ties to the smaller item."""
    groups = {"a": ([5.0, 3.0, 1.0, 0.0], 7), "b": ([1.0] * 9, 4), "c": ([1000.0, 1.0, 1.0], 1), "d": ([2.0, 2.0], 0), "e": ([float(k * k % 97 + 1) for k in range(60)], 500), "f": ([0.0], 3)}
    rows = [(g, i, w, seats) for g, (ws, seats) in groups.items() for i, w in enumerate(ws)]
    got: dict = {}
    for r in M.apportion(spark.createDataFrame(rows, "_group string, _item long, _weight double, _seats long")).collect():
        got.setdefault(r["_group"], {})[r["_item"]] = r["_q"]
    for g, (ws, seats) in groups.items():
        assert [got[g][i] for i in range(len(ws))] == (by_quotients(ws, seats) if any(ws) else [0] * len(ws)), g


def test_passes(spark, monkeypatch):
    """Each pass is a plan of its own, however many there are; they close in on the same seats."""
    plans, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, what))
    weights = [float(k * k % 97 + 1) for k in range(200)]
    items = spark.createDataFrame([("a", i, w, 5000) for i, w in enumerate(weights)], "_group string, _item long, _weight double, _seats long")
    want, passes = by_quotients(weights, 5000), []
    for ranked in (M.RANKED, -1):
        monkeypatch.setattr(M, "RANKED", ranked)
        plans.clear()
        got = {r["_item"]: r["_q"] for r in M.apportion(items).collect()}
        assert [got[i] for i in range(len(weights))] == want
        assert max(x.count("Join ") for x in plans) == 1
        passes.append(len(plans) - 1)
    assert passes == [1, M.PASSES]


def test_many_sources(spark):
    """A source a document, as with addresses: what is taken in all comes near the mix's size."""
    d = spark.range(900).selectExpr("id AS doc_id", "repeat('w ', cast(20 + id % 300 AS int)) AS text", "concat('u', id) AS source")
    out = M.mix(d).collect()
    want = targets({r["source"]: r["size"] for r in out})
    assert all(abs(r["target"] - want[r["source"]]) < 1e-5 for r in out) and abs(sum(r["taken"] for r in out) - sum(want.values())) < 0.05 * sum(want.values())


def test_edges(edges, nothing):
    out = check(edges, 3 * M.BLOCK)
    assert len(out) == edges.count() and {"kept", "n_chars"} <= set(out[0]) and all(r["size"] == 0 and r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert M.mix(nothing).count() == 0
