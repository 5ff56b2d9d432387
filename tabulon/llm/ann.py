"""Approximate nearest neighbours by balanced posting lists.

Cluster centres grow with the root of the number of vectors and are fitted in two steps on
samples; every vector is put on the list of its nearest centre, and boundary vectors on lists of several. A query finds its nearest centres
in a graph held in memory, and searches the lists whose centres are within a ratio of the
nearest one's distance.
"""

from __future__ import annotations

import heapq
import logging
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import worker_cache, written

#: Vectors a list is meant to hold; centres by the root of the number of vectors at most, so that
#: centres and lists grow alike; sampled vectors a centre that centres are fitted on.
LIST, BY_ROOT, A_CENTRE = 150, 4, 24
#: Distinct vectors that the first, coarse centres are fitted on, about.
SAMPLE = 20_000
#: A vector goes on lists of centres at most so much farther than its nearest, COPIES at most.
BOUNDARY, COPIES = 1.12, 4
#: A query searches lists of centres at most so much farther than its nearest, of BEAM found.
RATIO, BEAM = 1.30, 96
#: Links of a centre in the graph.
LINKS = 24
#: Vectors of a list that one task searches at once.
BLOCK = 4096


def _matrix(column) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def fit_centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Up to n balanced centres: k-means, in which clusters of more than twice the mean size
    are halved and those of under a tenth give up their centre, until no cluster is too large."""
    rng = np.random.default_rng(seed)
    n = min(n, len(x))
    c = x[rng.choice(len(x), n, replace=False)]
    for i in range(rounds):
        own = _square(x, c).argmin(1)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total[size > 0] / size[size > 0, None]
        size = size[size > 0]
        if i < rounds - 2:
            mean = len(x) / len(c)
            keep = size >= mean / 10
            large = np.flatnonzero(size > 2 * mean)
            extra = [c[k] + rng.normal(0, 1e-3, c.shape[1]) * (np.abs(c[k]).mean() + 1e-9) for k in large]
            c = np.concatenate([c[keep], *[e[None] for e in extra]])[: max(n, 1)]
    return c


def links_of(centres: np.ndarray, rows: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The nearest other centres of some of the centres."""
    k = min(links + 1, len(centres))
    out = np.zeros((len(rows), k), np.int64)
    step = max(1, 4_000_000 // len(centres))
    for lo in range(0, len(rows), step):
        at = rows[lo : lo + step]
        d = _square(centres[at], centres)
        d[np.arange(len(at)), at] = -1.0
        out[lo : lo + step] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


class Graph:
    """Centres linked to their nearest, searched best-first."""

    def __init__(self, centres: np.ndarray, nearest: np.ndarray | None = None):
        self.c = centres
        near: list[set[int]] = [set() for _ in centres]
        for i, js in enumerate(links_of(centres, np.arange(len(centres))) if nearest is None else nearest):
            near[i].update(int(j) for j in js if j != i)
        for i, js in enumerate([*map(tuple, near)]):
            for j in js:
                near[j].add(i)
        self.near = [np.array(sorted(s), np.int64) for s in near]
        # one entry for each part that links don't connect, and a few spread over all
        seen = np.zeros(len(centres), bool)
        self.entries = [*range(0, len(centres), max(1, len(centres) // 8))]
        todo = list(self.entries)
        seen[todo] = True
        k = 0
        while True:
            while todo:
                for j in self.near[todo.pop()].tolist():
                    if not seen[j]:
                        seen[j] = True
                        todo.append(j)
            while k < len(centres) and seen[k]:
                k += 1
            if k == len(centres):
                break
            self.entries.append(k)
            seen[k] = True
            todo.append(k)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``beam`` centres found and their distances, nearest first."""
        start = np.array(self.entries)
        d = np.sqrt(((self.c[start] - q) ** 2).sum(1))
        seen = set(self.entries)
        todo = [(x, int(i)) for x, i in zip(d, start, strict=True)]
        heapq.heapify(todo)
        best = [(-x, i) for x, i in todo]
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= beam and x > -best[0][0]:
                break
            new = [j for j in self.near[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for y, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)).tolist(), new, strict=True):
                if len(best) < beam or y < -best[0][0]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        got = sorted((-x, i) for x, i in best)
        return np.array([i for _, i in got]), np.array([x for x, _ in got])


def lists_of(x: np.ndarray, centres: np.ndarray, boundary: float, copies: int) -> list[list[int]]:
    """The lists of each vector: its nearest centre, and others within ``boundary`` times that
    distance that aren't nearer to a chosen centre than to the vector."""
    k, out = min(4 * copies, len(centres)), []
    step = max(1, 4_000_000 // len(centres))
    for lo in range(0, len(x), step):
        d = np.sqrt(_square(x[lo : lo + step], centres))
        order = np.argpartition(d, k - 1, axis=1)[:, :k]
        for row, near in zip(d, order, strict=True):
            near = near[np.argsort(row[near], kind="stable")]
            chosen = [int(near[0])]
            for j in near[1:].tolist():
                if len(chosen) == copies or row[j] > boundary * row[near[0]]:
                    break
                if all(((centres[j] - centres[i]) ** 2).sum() >= row[j] ** 2 for i in chosen):
                    chosen.append(j)
            out.append(chosen)
    return out


def centres_of(distinct: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres for n distinct vectors, by two steps: coarse ones on the driver, from about
    ``sample`` vectors, and the others cell by cell of those, from about A_CENTRE vectors each.
    There are at most BY_ROOT times the root of n, so they fit a task's memory."""
    spark = distinct.sparkSession
    wanted = int(np.clip(min(n // LIST, BY_ROOT * n**0.5), 1, None))
    u = F.shiftrightunsigned(F.xxhash64("rep", F.lit("centres")), 11) / float(1 << 53)
    some = distinct.filter(u * n <= sample).select("embedding", "rep").orderBy("rep").limit(2 * sample).toArrow()
    x = _matrix(some["embedding"].combine_chunks()) if some.num_rows else _matrix(distinct.limit(1).toArrow()["embedding"].combine_chunks())
    coarse = fit_centres(x, max(1, round(wanted**0.5)))
    shared = spark.sparkContext.broadcast(coarse)

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                own = _square(_matrix(batch.column(0)), shared.value).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "embedding", "rep"])

    share = min(1.0, A_CENTRE * wanted / n)

    def fine(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.stack(pdf.sort_values("rep")["embedding"].to_numpy())
        c = fit_centres(y, max(1, round(len(y) / share / n * wanted)))
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "nth": range(len(c)), "centre": list(c)})

    fitted = distinct.filter(u <= share).select("embedding", "rep").mapInArrow(cells, "cell int, embedding array<double>, rep long")
    found = fitted.groupBy("cell").applyInPandas(fine, "cell int, nth int, centre array<double>").orderBy("cell", "nth").toArrow()
    return _matrix(found["centre"].combine_chunks()) if found.num_rows else coarse


def linked_centres(spark, centres: np.ndarray) -> np.ndarray:
    """The graph's links, a block of centres a task."""
    shared = spark.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(0))
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(links_of(shared.value, at)), pa.list_(pa.int64()))], names=["id", "near"])

    ids = spark.range(0, len(centres), 1, max(1, len(centres) // 1000))
    return _matrix(ids.mapInArrow(run, "id long, near array<long>").orderBy("id").toArrow()["near"].combine_chunks()).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of vectors that take part, and of one length: the
    commonest (ties: the shorter)."""
    d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    d = d.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    size = d.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    if len(size) > 1:
        logging.getLogger(__name__).warning("vectors of other lengths than %d take no part, %d of length %d among them", size[0]["n"], size[1]["count"], size[1]["n"])
    return d.filter(F.size("embedding") == (size[0]["n"] if size else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = RATIO, beam: int = BEAM, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest other vectors by Euclidean distance.

    queries: vec_id of rows of ``vectors``. Null, zero and non-finite vectors, and those of
    another length than the commonest, take no part (the log says so). Equal vectors are one entry that holds
    the k + 1 smallest vec_ids, which is all that an answer can need; ties go to the smaller
    vec_id. Repeated vec_ids are one vector each. With fewer vectors than k, all are given;
    with none, none.
    """
    spark = vectors.sparkSession
    d = written(usable(vectors), "vectors").dropDuplicates()
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    some = d.withColumn("_n", first).filter(F.col("_n") <= k + 1)
    distinct = written(some.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "distinct")
    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    centres = centres_of(distinct, n, sample)
    model = spark.sparkContext.broadcast(centres)

    def assign(batches):
        c = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                lists = lists_of(_matrix(part.column(0)), c, BOUNDARY, COPIES)
                at = np.repeat(np.arange(len(lists)), [len(y) for y in lists])
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), took.column(0), took.column(1)], names=["list", "embedding", "ids"])

    posted = written(distinct.select("embedding", "ids").mapInArrow(assign, "list int, embedding array<double>, ids array<long>"), "lists")
    # as many rows as there are centres
    counts = written(posted.groupBy("list").agg(F.count("*").alias("n")), "sizes")
    blocks = F.broadcast(counts.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    held = np.zeros(len(centres), np.int64)
    for r in counts.collect():
        held[r["list"]] = r["n"]
    searched = spark.sparkContext.broadcast((linked_centres(spark, centres), held))
    key = os.urandom(8).hex()
    posted = posted.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).drop("blocks")

    asked = queries.select("vec_id").dropna().distinct().join(d, "vec_id").join(distinct.select("embedding", "rep"), "embedding").select("vec_id", "rep", "embedding")
    asked = written(asked, "queries")
    probes = asked.select("rep", "embedding").dropDuplicates(["rep"])

    def graph() -> Graph:
        kept = worker_cache("ann")
        if key not in kept:
            kept.clear()
            kept[key] = Graph(model.value, searched.value[0])
        return kept[key]

    def probe(batches):
        sizes = searched.value[1]
        for batch in batches:
            x = _matrix(batch.column(1))
            at, lists = [], []
            for i, q in enumerate(x):
                found, dist = graph().search(q, beam)
                # lists hold k + 1 vectors, each on COPIES of them at most, before the ratio prunes
                enough = np.r_[0, np.cumsum(sizes[found])[:-1]] < COPIES * (k + 1)
                take = found[enough | (dist <= ratio * max(dist[0], 1e-300))]
                if sizes[take].sum() < COPIES * (k + 1):
                    take = np.flatnonzero(sizes)
                at += [i] * len(take)
                lists += take.tolist()
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *took.columns], names=["list", "rep", "embedding"])

    probes = probes.mapInArrow(probe, "list int, rep long, embedding array<double>").join(blocks, "list")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(_key, lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(lefts) and len(rights):
            x, ids = np.stack(lefts["embedding"].to_numpy()), lefts["ids"].to_numpy()
            for lo in range(0, len(rights), 256):
                part = rights.iloc[lo : lo + 256]
                q = np.stack(part["embedding"].to_numpy())
                near = _square(q, x)
                m = min(k + 6, len(x))
                top = np.argpartition(near, m - 1, axis=1)[:, :m]
                for rep, y, cand in zip(part["rep"], q, top, strict=True):
                    dist = np.sqrt(((x[cand] - y) ** 2).sum(1))
                    got = sorted((float(s), int(i)) for s, j in zip(dist, cand, strict=True) for i in ids[j])[: k + 1]
                    out += [(rep, i, s) for s, i in got]
        return pd.DataFrame(out, columns=["rep", "near", "score"]).astype({"rep": "int64", "near": "int64", "score": "float64"})

    found = posted.groupBy("list", "block").cogroup(probes.groupBy("list", "block")).applyInPandas(search, "rep long, near long, score double")
    found = found.groupBy("rep", "near").agg(F.min("score").alias("score"))
    best = Window.partitionBy("rep").orderBy("score", "near")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    answers = asked.select("vec_id", "rep").join(found, "rep").filter(F.col("near") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("score", "near"))
    answers = answers.withColumn("rank", rank).filter(F.col("rank") <= k)
    return answers.select(F.col("vec_id").alias("query_id"), "rank", F.col("near").alias("vec_id"), "score")
