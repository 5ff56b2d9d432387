"""LM scoring by a probabilistic suffix tree over the bytes of a text's words.

A text is its words, lower-cased, each spelled out and closed by a space, and one end. A
state of the tree is a context of up to DEPTH bytes. Contexts frequent enough are tested: a
context stays when the next-byte distribution it has diverges from its parent's (its suffix
without the oldest byte) by more than chance would, or when a longer one that ends in it stays.
Distributions are smoothed with their parents'. A byte is scored in the state of the longest
suffix of what precedes it, so a text's score is a log probability.

Beside it stands the unigram of whole words that the base score asks for. Word counts have a
row for each word; frequent words (at most 1 / FREQUENT of them) go to all executors, and the
others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm.shared import crc32_of_id, release, written

DEPTH = 5
#: A tested context has at least so many times the root of the number of positions (and LEAST):
#: more contexts are tested the more text there is, and executors hold fewer than there are words.
TESTED, LEAST = 0.01, 4
#: Log-likelihood gain for each kind of next byte that a context must bring to stay, in nats.
GAIN = 1.0
#: Least share of all tokens of a word that is sent to all executors.
FREQUENT = 5e-7
SPACE, END = 0x20, 0x0A
_CHUNK, _HELD = 2 << 20, 1_500_000


def stream(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, before: np.ndarray):
    """The symbols of texts and n + 1 offsets in them."""
    inside = ~T.IS_WS[buf]
    src = np.flatnonzero(inside)
    bytes_before = np.r_[0, np.cumsum(inside)][offsets]
    cuts = bytes_before + before + np.arange(len(offsets))
    out = np.full(int(cuts[-1]), SPACE, np.uint8)
    word = np.zeros(len(buf), np.int64)
    word[starts] = 1
    word = np.cumsum(word)[src] - 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bytes_before))
    out[np.arange(len(src)) + word + doc] = T.LOWER[buf[src]]
    out[cuts[1:] - 1] = END
    return out, cuts


def grams(symbols: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The last DEPTH + 1 symbols at each place in one number, the newest lowest; a text begins
    after ends."""
    n = len(symbols)
    key = symbols.astype(T.U64)
    for k in range(1, DEPTH + 1):
        prev = np.full(n, END, np.uint8)
        prev[k:] = symbols[: max(0, n - k)]
        for j in range(k):
            at = cuts[:-1] + j
            prev[at[at < n]] = END
        key |= prev.astype(T.U64) << T.U64(8 * k)
    return key


class _Counter:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        x = np.sort(keys)
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        self.parts.append((x[at], np.diff(np.r_[at, len(x)])))
        self.size += len(at)
        if self.size > _HELD and len(self.parts) > 1:
            self.merge()

    def merge(self):
        k = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, T.U64)
        n = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        self.parts = [(k[at], np.add.reduceat(n, at) if len(at) else n)]
        self.size = 0
        return self.parts[0]


def count(docs: DataFrame) -> DataFrame:
    """kind (0 word, 1 n-gram), key and n over all texts of docs."""

    def run(batches):
        words, ngrams = _Counter(), _Counter()
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(0))
            for lo, hi in T.chunks(off_all, _CHUNK):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                starts, ends, before = T.spans(buf, off, T.IS_WS)
                words.add(T.span_hashes(buf, starts, ends, True))
                ngrams.add(grams(*stream(buf, off, starts, before)))
        for kind, c in ((0, words), (1, ngrams)):
            k, n = c.merge()
            for lo in range(0, len(k), 100_000):
                part = k[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(n[lo : lo + 100_000].astype(np.int64))], names=["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def build_tree(levels: list[tuple[np.ndarray, np.ndarray]], gain: float = GAIN) -> dict:
    """The tree from (n-gram, count) of each context length: arrays sorted for lookup.

    levels[k] holds n-grams of k + 1 symbols whose context is to be tested, those of k = 0 all.
    """
    root = np.bincount(levels[0][0].astype(np.int64), levels[0][1], 256) + 0.5
    root /= root.sum()
    p_of = [root]  # of level k's n-grams, under the smoothed distribution of their own context
    contexts, owners, totals, kinds, gains = [None], [None], [None], [None], [None]
    keys = [np.arange(256, dtype=T.U64)]
    for k in range(1, len(levels)):
        g, n = levels[k]
        order = np.argsort(g)
        g, n = g[order], n[order].astype(np.float64)
        ctx, own = np.unique(g >> T.U64(8), return_inverse=True)
        total, kind = np.bincount(own, n, len(ctx)), np.bincount(own, minlength=len(ctx))
        low = g & T.U64((1 << (8 * k)) - 1)
        at = np.minimum(np.searchsorted(keys[k - 1], low), len(keys[k - 1]) - 1)
        above = p_of[k - 1][at]  # a tested context's suffix is tested too, as it is as frequent
        own_p = (n + kind[own] * above) / (total + kind)[own]
        gains.append(np.bincount(own, n * np.log((n / total[own]) / above), len(ctx)))
        keys.append(g)
        p_of.append(own_p)
        contexts.append(ctx)
        owners.append(own)
        totals.append(total)
        kinds.append(kind)
    keep = [None] + [g > gain * t for g, t in zip(gains[1:], kinds[1:], strict=True)]
    for k in range(len(levels) - 1, 1, -1):
        below = np.unique(contexts[k][keep[k]] & T.U64((1 << (8 * (k - 1))) - 1))
        keep[k - 1] |= np.isin(contexts[k - 1], below)
    tree = {"root": _logs(root).astype(np.float64), "levels": []}
    for k in range(1, len(levels)):
        entry = keep[k][owners[k]]
        tree["levels"].append((contexts[k][keep[k]], _logs(kinds[k] / (totals[k] + kinds[k]))[keep[k]], keys[k][entry], _logs(p_of[k])[entry]))
    return tree


def _find(keys: np.ndarray, wanted: np.ndarray):
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(tree: dict, g: np.ndarray) -> np.ndarray:
    """log10 probability of the newest symbol of each n-gram after the others."""
    out, todo = np.zeros(len(g)), np.arange(len(g))
    for k in range(len(tree["levels"]), 0, -1):
        ctx, left, entry, p = tree["levels"][k - 1]
        x = g[todo] & T.U64((1 << (8 * (k + 1))) - 1)
        at, state = _find(ctx, x >> T.U64(8))
        e, found = _find(entry, x)
        found &= state
        out[todo[found]] += p[e[found]]
        some = state & ~found
        out[todo[some]] += left[at[some]]
        todo = todo[~found]
    out[todo] += tree["root"][(g[todo] & T.U64(255)).astype(np.int64)]
    return out


def train(docs: DataFrame, tested: float = TESTED, least: int = LEAST, gain: float = GAIN, frequent: float = FREQUENT) -> dict:
    """Counts of all texts of docs, the tree, and the frequent words.

    The tree grows with the root of the text; the frequent words are bounded by their least
    share; the counts of all words stay in a table.
    """
    counts = written(count(docs), "counts")
    n_docs = docs.count()
    words = counts.filter("kind = 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    tokens, distinct = n + n_docs, v + (1 if n_docs else 0)
    grams = counts.filter("kind = 1").select("key", "n")
    places = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    most = max(least, tested * float(places) ** 0.5)
    levels, made = [], []
    for k in range(DEPTH, -1, -1):  # an order's counts come from the longer one's
        if k < DEPTH:
            grams = written(grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")).agg(F.sum("n").alias("n")), "order")
            made.append(grams)
        g = grams
        if k:
            total = grams.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias("t")).filter(F.col("t") >= most).drop("t")
            g = grams.join(total, F.shiftright("key", 8) == F.col("c"), "left_semi")
        t = g.select("key", "n").toArrow()
        levels.insert(0, (t["key"].to_numpy().astype(T.U64), t["n"].to_numpy()))
    release(*made)
    often = words.filter(F.col("n") >= max(1.0, frequent * tokens)).select("key", "n").toArrow()
    keys, times = often["key"].to_numpy().astype(T.U64), often["n"].to_numpy()
    order = np.argsort(keys)
    return {
        "tokens": int(tokens), "distinct": int(distinct), "docs": int(n_docs), "words": words.select("key", "n"),
        "tree": build_tree(levels, gain), "keys": keys[order], "counts": times[order],
    }


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of docs but text, and n_tokens, n_known, train_tokens, base_score and score.

    A null text is empty: its only token is the end. Repeated rows and null ids are scored row
    by row. An empty table gives none; a model of no text scores every byte alike.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(*rest, "text")
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("tree", "keys", "counts", "tokens", "distinct", "docs")})
    base_of = float(np.log10(model["tokens"] + 0.5 * (model["distinct"] + 1)))
    schema = ", ".join([*(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in rest), "n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"])

    def run(batches):
        m = shared.value
        log_end = np.log10(m["docs"] + 0.5)
        logs = np.log10(m["counts"] + 0.5)
        names = [*rest, "n_tokens", "n_known", "base_score", "score", "rare", "times"]
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(len(rest)))
            for lo, hi in T.chunks(off_all, _CHUNK):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                starts, ends, before = T.spans(buf, off, T.IS_WS)
                symbols, cuts = stream(buf, off, starts, before)
                g, back = np.unique(grams(symbols, cuts), return_inverse=True)
                total = np.r_[0.0, np.cumsum(log_probabilities(m["tree"], g)[back])]
                h = T.span_hashes(buf, starts, ends, True)
                at, known = _find(m["keys"], h)
                words = np.diff(before)
                base = np.r_[0.0, np.cumsum(np.where(known, logs[at] if len(logs) else 0.0, 0.0))]
                n_known = np.r_[0, np.cumsum(known)]
                # the other words, each once a text
                rare = np.flatnonzero(~known)
                doc = np.searchsorted(before, rare, "right") - 1
                order = np.lexsort((h[rare], doc))
                r, o = h[rare][order], doc[order]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]) if len(r) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(r)]).astype(np.int32)
                lists = pa.array(np.searchsorted(o[new], np.arange(hi - lo + 1)).astype(np.int32))
                values = [words + 1, n_known[before[1:]] - n_known[before[:-1]] + (1 if m["docs"] else 0), base[before[1:]] - base[before[:-1]] + log_end - base_of * (words + 1), total[cuts[1:]] - total[cuts[:-1]]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(rest))), *map(pa.array, values), pa.ListArray.from_arrays(lists, pa.array(r[new].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times))], names=names)

    part = written(d.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = part.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    rare = rare.join(model["words"], "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"))
    out = part.drop("rare", "times").join(rare, "_row", "left")
    return out.select(*rest, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model["tokens"]).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score")


def held_out(column):
    """Whether a document is of the fifth that is never learned from."""
    return F.coalesce(crc32_of_id(column) % 5 == 1, F.lit(False))
