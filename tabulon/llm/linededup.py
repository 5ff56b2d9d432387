"""Line dedup by pairwise alignment of documents that share block-sized runs of lines.

A line is known by a hash of its text. The shortest runs of lines that are long enough to be
deleted are anchors; a document is paired with the earliest one that has the anchor. Each
pair's lines are aligned by patience diff, and common blocks are deleted from the later
document. Only line hashes are moved for that; texts are read once more at the end.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm.shared import schema_with, written

#: A common block is deleted from so many words on.
BLOCK_WORDS = 20
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def lines_of(buf: np.ndarray, offsets: np.ndarray):
    """Hashes and word counts of the lines with a word, their starts and ends, and how many
    stand before each offset."""
    a, b, _ = T.spans(buf, offsets, _NEWLINE)
    starts, _, _ = T.spans(buf, offsets, T.IS_WS)
    words = np.searchsorted(starts, b) - np.searchsorted(starts, a)
    full = words > 0
    a, b, words = a[full], b[full], words[full]
    # white space around a line doesn't count
    first = starts[np.searchsorted(starts, a)]
    inside = np.r_[np.flatnonzero(~T.IS_WS[buf])]
    last = inside[np.searchsorted(inside, b) - 1] + 1
    return T.span_hashes(buf, first, last, False), words, a, b, np.searchsorted(a, offsets)


def common_blocks(x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff: (start in x, start in y, length) of aligned equal runs, in order.

    Lines once in both sides of a range and in the same order anchor it (the longest
    increasing run of them); between anchors, and where a range has none, equal lines at its
    ends are matched. No recursion: ranges wait on a list.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        at: dict[int, int | None] = {}
        for i in range(a0, a1):
            at[x[i]] = None if x[i] in at else i
        seen: dict[int, int | None] = {}
        for j in range(b0, b1):
            seen[y[j]] = None if y[j] in seen else j
        once = [(at[v], j) for v, j in seen.items() if j is not None and at.get(v) is not None]
        once.sort(key=lambda p: p[1])
        tails: list[int] = []
        heads: list[int] = []
        back: list[int] = []
        for n, (i, _) in enumerate(once):
            k = bisect_left(tails, i)
            back.append(heads[k - 1] if k else -1)
            if k == len(tails):
                tails.append(i)
                heads.append(n)
            else:
                tails[k], heads[k] = i, n
        n, chain = heads[-1] if heads else -1, []
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        if not chain:
            n = len(pairs)
            while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
                pairs.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                pairs.append((a1, b1))
            if len(pairs) > n:  # what is left may have lines that are unique in it
                todo.append((a0, a1, b0, b1))
            continue
        i0, j0 = a0, b0
        for i, j in reversed(chain):
            todo.append((i0, i, j0, j))
            pairs.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    pairs.sort()
    out: list[tuple[int, int, int]] = []
    for i, j in pairs:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def windows(lines: np.ndarray, words: np.ndarray, before: np.ndarray, block_words: int):
    """Hashes, first lines, ends and documents of the shortest runs of lines that reach
    ``block_words`` words, from each line on and up to each line. A run lies in one document.

    Each line of a run of so many words that two documents have lies in a shortest run that
    both have: in the one from it on, or else in the one up to the run's end.
    """
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    n = len(lines)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    on = np.searchsorted(total, total[:-1] + block_words)
    back = np.searchsorted(total, total[1:] - block_words, "right") - 1
    a, z = np.r_[np.arange(n), np.maximum(back, 0)], np.r_[on, np.arange(1, n + 1)]
    doc = np.r_[doc, doc]
    fits = (z <= before[doc + 1]) & (a >= before[doc]) & np.r_[np.ones(n, bool), back >= 0]
    a, z, doc = a[fits], z[fits], doc[fits]
    pw, inv = T._powers(n)
    with np.errstate(over="ignore"):
        sums = np.r_[T.U64(0), np.cumsum(lines * pw, dtype=T.U64)]
        return T.fmix((sums[z] - sums[a]) * inv[a] + (z - a).astype(T.U64) * T.U64(0xD6E8FEB86659FD93)), a, z, doc


def shred(docs: DataFrame, block_words: int) -> DataFrame:
    """doc_id, lines, words and windows: hashes and word counts of each document's lines with a
    word, and the distinct hashes of its block-sized runs of lines."""

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(1))
            for lo, hi in T.chunks(off_all):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                h, w, _, _, before = lines_of(buf, off)
                cut = pa.array(before.astype(np.int32))
                key, _, _, of = windows(h, w, before, block_words)
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
                runs = pa.array(np.searchsorted(of[new], np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(w.astype(np.int32))), pa.ListArray.from_arrays(runs, pa.array(key[new].view(np.int64)))],
                    names=["doc_id", "lines", "words", "windows"],
                )

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, schema_with(d.drop("text"), ("lines", "array<long>"), ("words", "array<int>"), ("windows", "array<long>")))


def overlaps(rows: DataFrame) -> DataFrame:
    """Pairs (earlier, later) of documents with a common anchor: each document with the
    earliest holder of each of its windows, so a window in most documents gives as many pairs
    as it has holders."""
    one = rows.select("doc_id", F.explode("windows").alias("window"))
    held = one.groupBy("window").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last")).filter("earlier < last").select("window", "earlier")
    return one.join(held, "window").filter("doc_id <> earlier").select("earlier", F.col("doc_id").alias("later")).distinct()


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and its n + 1 offsets in them."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), at - at[0]


def _of_row(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Hashes made different between rows."""
    with np.errstate(over="ignore"):
        return T.fmix(key + (of.astype(T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))


def aligned(rows: DataFrame, pairs: DataFrame, block_words: int) -> DataFrame:
    """doc_id and drop: the numbers of the lines that the alignments delete from it.

    A diff pairs a passage once at most and in order. So runs of the later document that stand
    anywhere else in the earlier one, repeated in either or moved, are matched beside it.
    """
    side = lambda c: rows.select(F.col("doc_id").alias(c), F.col("lines").alias(f"l_{c}"), F.col("words").alias(f"w_{c}"))
    d = pairs.join(side("earlier"), "earlier").join(side("later"), "later").select("later", "l_earlier", "w_earlier", "l_later", "w_later")

    def run(batches):
        for batch in batches:
            (x, x_at), (v, _), (y, y_at), (w, _) = (_flat(batch.column(i)) for i in (1, 2, 3, 4))
            x, y = x.view(T.U64), y.view(T.U64)
            total = np.r_[0, np.cumsum(w, dtype=np.int64)]
            there, _, _, x_of = windows(x, v, x_at, block_words)
            here, a, z, y_of = windows(y, w, y_at, block_words)
            again = np.isin(_of_row(here, y_of), _of_row(there, x_of))
            edge = np.zeros(len(y) + 1, np.int64)
            np.add.at(edge, a[again], 1)
            np.add.at(edge, z[again], -1)
            gone = np.cumsum(edge[:-1]) > 0
            for k in range(batch.num_rows):
                lo = y_at[k]
                for _, j, n in common_blocks(x[x_at[k] : x_at[k + 1]].tolist(), y[lo : y_at[k + 1]].tolist()):
                    if total[lo + j + n] - total[lo + j] >= block_words:
                        gone[lo + j : lo + j + n] = True
            at = np.flatnonzero(gone)
            cut = np.searchsorted(at, y_at)
            number = at - np.repeat(y_at[:-1], np.diff(cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(number.astype(np.int32)))], names=["doc_id", "drop"])

    found = d.mapInArrow(run, "doc_id long, drop array<int>")
    return found.select("doc_id", F.explode("drop").alias("n")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("n")).alias("drop"))


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of docs, text without the deleted lines, and n_lines, n_removed, words_removed.

    Of documents that share a block of lines, the one of smallest doc_id keeps it. A block is
    a run of lines in both, of ``block_words`` words at least; each time the later one has
    it, it goes. Shorter common lines stay. Lines without a word belong to none and stay. A null text or doc_id stays as it is
    (n_lines of a null text is 0); rows with one doc_id are one document, of which each row
    loses the lines that any of their alignments names by number; equal lines of one document
    aren't its overlap with another. An empty table gives none. A document that loses all its
    lines stays with the text ''. Columns of docs with the result's names are replaced.
    """
    own = ("n_lines", "n_removed", "words_removed")
    docs = docs.drop(*own)
    rows = written(shred(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"), block_words), "lines")
    pairs = written(overlaps(rows), "overlaps")
    drop = written(aligned(rows, pairs, block_words), "aligned")
    # by shuffle at any size: what is deleted grows with the corpus
    d = docs.join(drop.hint("merge"), "doc_id", "left").select(*docs.columns, "drop")
    at, schema = docs.columns.index("text"), schema_with(docs, *[(c, "long") for c in own])
    names = schema.names

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            nulls = np.asarray(text.is_null())
            drops = batch.column(len(names) - len(own)).to_pylist()
            buf_all, off_all = T.texts(text)
            for lo, hi in T.chunks(off_all):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                _, w, a, b, before = lines_of(buf, off)
                texts, n_removed, gone = [], [], []
                for d in range(hi - lo):
                    raw = buf[off[d] : off[d + 1]]
                    cut = [before[d] + n for n in drops[lo + d] or [] if n < before[d + 1] - before[d]]
                    if cut:
                        keep = np.ones(len(raw), bool)
                        for k in cut:  # with the line end after it
                            keep[a[k] - off[d] : b[k] - off[d] + 1] = False
                        raw = raw[keep]
                        raw = raw[:-1] if len(raw) and cut[-1] == before[d + 1] - 1 and raw[-1] == 10 else raw
                    texts.append(None if nulls[lo + d] else raw.tobytes().decode("utf-8", "replace"))
                    n_removed.append(len(cut))
                    gone.append(int(w[cut].sum()) if cut else 0)
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(names) - len(own))]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(before)), pa.array(n_removed, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return d.mapInArrow(run, schema)
