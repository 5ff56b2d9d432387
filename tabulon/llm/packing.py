"""Packing documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm import tokens
from tabulon.llm.shared import vocabulary, written

LENGTH, END = 4096, 2
#: Pieces that one group is meant to rank, and the fewest and most groups of a length.
RANKED, LEAST, MOST = 500_000, 64, 4096
_CHUNK = 4 << 20


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece of at most ``length`` ids.

    A null text is empty: its only id is ``end``.
    """

    def run(batches):
        enc, tail = tokens.encoder(tokens.WordIds, path), np.array([end], "<u4").tobytes()
        for batch in batches:
            buf, off = T.texts(batch.column(1))
            raw = buf.tobytes()
            for lo, hi in T.chunks(off, _CHUNK):
                at, start, size, crc, total = [], [], [], [], []
                o = off[lo : hi + 1].tolist()
                for d, ids in enumerate(enc.encode([raw[a:b] for a, b in zip(o[:-1], o[1:], strict=True)])):
                    ids += tail
                    for a in range(0, len(ids), 4 * length):
                        part = ids[a : a + 4 * length]
                        at.append(lo + d)
                        start.append(a // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, d.drop("text").schema.add("start", "long").add("length", "long").add("ids_crc32", "long").add("doc_tokens", "long"))


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts: lengths are placed longest first, each into packs with
    the most room left, as many packs of a pattern at once as there are pieces. Where none has
    room, a new pack takes pieces of the length until it is full."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # ascending
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lens: tuple[int, ...], n: int, room: int) -> None:
        if room == 0:
            done.append((lens, n))
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((lens, n))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            if rooms and rooms[-1] >= size:
                room = rooms[-1]
                lens, have = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop()
                if have > n:
                    put(lens, have - n, room)
                used = min(n, have)
                put((*lens, size), used, room - size)
                n -= used
            else:
                each = length // size
                packs, rest = divmod(n, each)
                if packs:
                    put((size,) * each, packs, length - each * size)
                if rest:
                    put((size,) * rest, 1, length - rest * size)
                n = 0
    return done + [x for room in rooms for x in by_room[room]]


def slots(found: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """For each piece length the slots that patterns have for it: first rank, first sequence
    and offset of each, sorted; ``begin`` is where a length's slots start."""
    sizes, base, count, offset, first = [], [], [], [], 0
    for lens, n in found:
        at = 0
        for x in lens:
            sizes.append(x)
            base.append(first)
            count.append(n)
            offset.append(at)
            at += x
        first += n
    size = np.array(sizes, np.int64)
    order = np.argsort(size, kind="stable")
    size, n = size[order], np.array(count, np.int64)[order]
    begin = np.searchsorted(size, np.arange(length + 2))
    ends = np.cumsum(n)
    rank = ends - n
    rank = rank - np.r_[rank, 0][np.minimum(begin[size], len(rank))] if len(rank) else rank
    return {"begin": begin, "rank": rank, "base": np.array(base, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece.

    A document is cut after each ``length`` ids. The histogram of piece lengths, at most
    ``length`` rows, goes to the driver, which finds the patterns; a piece gets its place from
    its rank among those of its length. Ranks are counted in salted groups of a length, so a
    length that most pieces have isn't one task's work. Null texts are empty and have the end
    id only, repeated rows are packed each, an empty table gives none; columns other than
    doc_id and text aren't read.
    """
    d = written(pieces(docs, path or vocabulary("word_bpe_49k.json"), length, end), "pieces")
    histogram = {r["length"]: r["n"] for r in d.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(patterns(histogram, length), length)
    salts = int(np.clip(sum(histogram.values()) // RANKED, LEAST, MOST))
    d = d.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = d.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # at most LENGTH * MOST rows
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    d = d.withColumn("_nth", nth).join(counts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_nth") - 1)
    d = d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank")
    shared = d.sparkSession.sparkContext.broadcast(table)
    schema = d.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def place(batches):
        t = shared.value
        for batch in batches:
            size, rank = np.asarray(batch.column(2)), np.asarray(batch.column(5))
            k, order = np.zeros(len(size), np.int64), np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                at, s = order[a:b], int(size[order[a]])
                lo, hi = int(t["begin"][s]), int(t["begin"][s + 1])
                k[at] = lo + np.searchsorted(t["rank"][lo:hi], rank[at], "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(t["base"][k] + rank - t["rank"][k]), pa.array(t["offset"][k])], names=names)

    return d.mapInArrow(place, schema)
