"""Quality rules: word and line statistics, and perplexity bands of a modified Kneser-Ney model.

The model is over the code points of a text in windows of ORDER. A code point is a symbol of
BITS bits: below 2048 it is itself (ASCII lower-cased, white space a space, digits one symbol),
above it falls in one of 2048 hashed classes. So an n-gram is a number, its context that
number without the lowest symbol, and what it ends in that number without the highest.

Spark counts the n-grams of every distinct text, and from each order the kinds of symbols
before the n-grams of the order below. The texts of a language are in two folds by their hash,
and each fold is scored by the model of the other: no text, and no copy of it, speaks for
itself. A model has every n-gram of its texts, as arrays sorted by hash. They are in parts by
context, as many as it takes, in a folder of its own; who scores its texts reads the parts there
and holds as many as fit.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm.shared import if_small, new_dir, release, schema_with, worker_cache, written

ORDER, BITS, FOLDS = 5, 12, 2
START = 1
_SYM = (1 << BITS) - 1
#: N-grams of all orders that a part of a model is meant to hold, and what contexts are dealt by.
PART, PRIME = 1_000_000, 1_000_003
#: A language has a band if so many of its distinct texts have 50 words or more.
SOUND_TEXTS = 8
#: How many times the distance from the median to the first and to the third quartile of its
#: language's log perplexities a document may lie below and above the median.
BELOW, ABOVE = 12.0, 12.0
#: Least distance to a quartile that a band is made of, in nats a symbol: where near copies are
#: most of a language, its quartiles say nothing of the rest.
SPREAD = 0.05
#: Bytes of models that a worker holds beside the part in use, and n-grams that a counting task holds.
HELD_BYTES, HELD = 160 << 20, 1_500_000
_CHUNK = 2 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _range_sum(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[b] - c[a]


def _in_text(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes made different between texts: equal only within one."""
    of = np.repeat(np.arange(len(before) - 1, dtype=np.int64), np.diff(before)).astype(T.U64)
    with np.errstate(over="ignore"):
        return T.fmix(h + (of + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, before = T.spans(buf, offsets, T.IS_WS)
    n_words = np.diff(before)
    out = {"n_words": n_words}
    in_word = ~T.IS_WS[buf]
    out["word_chars"] = _range_sum(in_word & _LEAD[buf], offsets[:-1], offsets[1:])
    out["n_symbols"] = _range_sum(_SYMBOL[buf], offsets[:-1], offsets[1:])

    a, b, lines_before = T.spans(buf, offsets, _NEWLINE)
    keys = _in_text(T.span_hashes(buf, a, b, False), lines_before)
    full = _range_sum(in_word, a, b) > 0
    kept_before = np.r_[0, np.cumsum(full)][lines_before]
    _, first = np.unique(keys[full], return_index=True)
    of_line = np.searchsorted(kept_before, first, "right") - 1
    out["n_dup_lines"] = np.diff(kept_before) - np.bincount(of_line, minlength=len(n_words)).astype(np.int64)

    h, n = T.span_hashes(buf, starts, ends, False), len(starts)
    marked = np.zeros(n + 2, bool)
    if n >= 3:
        with np.errstate(over="ignore"):
            w = (h[:-2] * T.U64(0x9DDFEA08EB382D69) + h[1:-1]) * T.U64(0x9DDFEA08EB382D69) + h[2:]
        of = np.repeat(np.arange(len(n_words)), n_words)
        inside = of[:-2] == of[2:]
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            key = T.fmix(w[at] + (of[at].astype(T.U64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            marked[at[again] + k] = True
    out["n_repeat_words"] = _range_sum(marked[:n], before[:-1], before[1:])
    return out


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts and n + 1 offsets in them."""
    pos = np.flatnonzero(_LEAD[buf])
    at = np.searchsorted(pos, offsets)
    x = buf[pos].astype(np.int64)
    wide = np.flatnonzero(x >= 0x80)
    if len(wide):
        b = [buf[np.minimum(pos[wide] + k, len(buf) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        y = x[wide]
        two, three = (y & 0x1F) << 6 | b[0], (y & 0x0F) << 12 | b[0] << 6 | b[1]
        x[wide] = np.where(y < 0xE0, two, np.where(y < 0xF0, three, (y & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2]))
    x[(x >= 65) & (x <= 90)] += 32
    x[(x >= 48) & (x <= 57)] = 48
    x[(x >= 9) & (x <= 13)] = 32
    high = np.flatnonzero(x >= 2048)
    if len(high):
        x[high] = 2048 | (T.fmix(x[high].astype(T.U64)) & T.U64(2047)).astype(np.int64)
    return x, at


def codes(sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol; a text begins after ORDER - 1 starts."""
    out, n = sym.copy(), len(sym)
    for k in range(1, ORDER):
        prev = np.full(n, START, np.int64)
        prev[k:] = sym[: max(0, n - k)]
        for j in range(k):
            at = offsets[:-1] + j
            prev[at[at < offsets[1:]]] = START
        out |= prev << (BITS * k)
    return out


def model_name(langs: list, folds: list) -> list:
    """What the models of texts are named: fold and language; a null lang is one of its own."""
    return [f"{fold}{'' if lang is None else ':' + lang}" for lang, fold in zip(langs, folds, strict=True)]


def with_fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """lang, packed (the text, compressed, so that less is moved) and fold of each distinct text."""
    d = with_fold(docs.select("lang", "text").filter("text is not null"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            buf, off = T.texts(batch.column(1))
            raw, off = buf.tobytes(), off.tolist()
            packed = [pack(raw[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["lang", "packed", "fold"])

    return d.mapInArrow(run, "lang string, packed binary, fold int").distinct()


def count_ngrams(docs: DataFrame) -> DataFrame:
    """model (its name), g and raw (its count) of every n-gram of every distinct text, however
    many copies it has."""
    d = distinct_texts(docs)

    def run(batches):
        held, size = {}, 0

        def out():
            for name, parts in held.items():
                g, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)
                for i in range(0, len(g), 100_000):
                    part = g[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[i : i + 100_000])], names=["model", "g", "raw"])

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(x) for x in batch.column(1).to_pylist()]
            off_all = np.r_[0, np.cumsum([len(x) for x in texts], dtype=np.int64)]
            buf_all = np.frombuffer(b"".join(texts), np.uint8)
            names = model_name(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            for lo, hi in T.chunks(off_all, _CHUNK):
                sym, off = symbols(buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo])
                code, own = codes(sym, off), names[lo:hi]
                of = np.repeat(np.arange(hi - lo), np.diff(off))
                for name in dict.fromkeys(own):
                    mine = np.array([x == name for x in own])
                    g, n = np.unique(code if mine.all() else code[mine[of]], return_counts=True)
                    held.setdefault(name, []).append((g, n))
                    size += len(g)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return d.mapInArrow(run, "model string, g long, raw long").groupBy("model", "g").agg(F.sum("raw").alias("raw"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = (max(float(n or 0), 1.0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.r_[0.0, np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.1, 2.5)]


def _after(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discounts."""
    return c - np.minimum(d[np.clip(c, 0, 3).astype(np.int64)], c * 0.9)


def _hash(order: int, gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.fmix(gram.astype(T.U64) + T.U64(order) * T.U64(0x9E3779B97F4A7C15) + T.U64(1))


def _look(keys: np.ndarray, values: np.ndarray, order: int, gram: np.ndarray, missing: float) -> np.ndarray:
    """Values beside the sorted hashes."""
    if not len(keys):
        return np.full(len(gram), missing)
    wanted = _hash(order, gram)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


PARTS = ("gram", "share", "context", "left")
_TYPES = (T.U64, np.float64, T.U64, np.float64)


def folder_name(model: str) -> str:
    return hashlib.md5(model.encode()).hexdigest()


def home(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part that n-grams and their contexts are in."""
    return (grams >> BITS) % PRIME % parts


def fit(counts: DataFrame, share: float = 0.0, part: int = PART) -> str:
    """Write each model's arrays to a folder of its own, and give the folder of all. An order's
    arrays are the sorted hashes of its n-grams, beside them their discounted shares of their
    contexts, and the sorted hashes of its contexts, beside them what each leaves to the order
    below: 1 less the shares of the n-grams kept. A context and all its n-grams, at most
    2**BITS, are in one of as many parts as make ``part`` n-grams each.

    All n-grams are kept, unless ``share`` asks for those only that have such a share of their
    model's places; the others still count towards kinds and totals."""
    spark = counts.sparkSession
    levels = [written(counts.withColumn("c", F.col("raw")), "ngrams")]
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        levels.append(written(levels[-1].groupBy("model", low.alias("g")).agg(F.sum("raw").alias("raw"), F.count("*").alias("c")), "ngrams"))
    rows = None
    for k, d in zip(range(ORDER, 0, -1), levels, strict=True):
        d = d.withColumn("order", F.lit(k))
        rows = d if rows is None else rows.unionByName(d)
    kinds = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    sizes = rows.groupBy("model", "order").agg(*kinds, F.count("*").alias("_n"), F.sum("raw").alias("places"))
    of_all = Window.partitionBy("model")  # a row an order
    sizes = written(sizes.withColumn("parts", F.ceil(F.sum("_n").over(of_all) / part).cast("long")).drop("_n"), "sizes")
    d = rows.join(if_small(sizes), ["model", "order"]).withColumn("part", F.shiftrightunsigned("g", BITS) % PRIME % F.col("parts"))
    d = d.withColumn("kept", F.col("raw") >= share * F.col("places")).select("model", "part", "parts", "order", "g", "c", "kept", "n1", "n2", "n3", "n4")

    def of_part(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(1, ORDER + 1):
            own = pdf[pdf["order"] == k]
            g, c, kept = own["g"].to_numpy(np.int64), own["c"].to_numpy(np.int64), own["kept"].to_numpy(bool)
            ctx, back = np.unique(g >> BITS, return_inverse=True)
            total = np.bincount(back, c, len(ctx))[back]
            p = _after(c, discounts(*own[["n1", "n2", "n3", "n4"]].iloc[0])) / total if len(own) else total
            left = 1 - np.bincount(back[kept], p[kept], len(ctx))
            h, hc = _hash(k, g[kept]), _hash(k + ORDER, ctx)
            i, j = np.argsort(h), np.argsort(hc)
            out.append([x.tobytes() for x in (h[i], p[kept][i], hc[j], left[j])])
        name, at, of = folder_name(pdf["model"].iloc[0]), pdf["part"].iloc[0], pdf["parts"].iloc[0]
        return pd.DataFrame({"_m": [name] * ORDER, "_p": [f"{at}-{of}"] * ORDER, "order": range(1, ORDER + 1), **{n: [x[i] for x in out] for i, n in enumerate(PARTS)}})

    path = new_dir(spark, "quality-model")
    schema = "_m string, _p string, order int, " + ", ".join(f"{n} binary" for n in PARTS)
    d.groupBy("model", "part").applyInPandas(of_part, schema).write.partitionBy("_m", "_p").parquet(path)
    release(*levels)
    return path


class Held:
    """The parts used last, of at most ``most`` bytes beside the one in use."""

    def __init__(self, most: int = HELD_BYTES):
        self.most, self.size, self.parts = most, 0, {}

    def get(self, address: str, load) -> list[tuple]:
        if address in self.parts:
            self.parts[address] = self.parts.pop(address)
        else:
            self.parts[address] = load()
            self.size += self._bytes(address)
            while self.size - self._bytes(address) > self.most:
                self.size -= self._bytes(oldest := next(iter(self.parts)))
                del self.parts[oldest]
        return self.parts[address]

    def _bytes(self, address: str) -> int:
        return sum(x.nbytes for o in self.parts[address] for x in o)


class Model:
    """A model's arrays, read part by part."""

    def __init__(self, store: fs.FileSystem, folders: dict[int, str], parts: int, held: Held):
        self.store, self.folders, self.parts, self.held = store, folders, parts, held

    @classmethod
    def read(cls, path: str, name: str, held: Held | None = None) -> Model | None:
        """From the folder that ``fit`` gave, in whatever store it is; None if it isn't there."""
        store, at = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        at = f"{at}/_m={folder_name(name)}"
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        found = [(*map(int, x.base_name[3:].split("-")), x.path) for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.startswith("_p=")]
        return cls(store, {i: folder for i, _, folder in found}, found[0][1], held or Held())

    def _load(self, folder: str) -> list[tuple]:
        rows = ds.dataset(folder, filesystem=self.store, format="parquet").to_table().to_pylist()
        return [tuple(np.frombuffer(r[n], t) for n, t in zip(PARTS, _TYPES, strict=True)) for r in sorted(rows, key=lambda r: r["order"])]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the lowest symbol of each n-gram after the others."""
        of_order = [grams & ((1 << (BITS * k)) - 1) for k in range(1, ORDER + 1)]
        share, left = np.zeros((ORDER, len(grams))), np.ones((ORDER, len(grams)))
        homes = [home(g, self.parts) for g in of_order] if self.parts > 1 else None
        # those held come first, so that a model larger than what is held isn't read whole again
        for i, folder in sorted(self.folders.items(), key=lambda x: x[1] not in self.held.parts):
            for k, (gram, shares, context, lefts) in enumerate(self.held.get(folder, lambda: self._load(folder)), 1):
                at = np.flatnonzero(homes[k - 1] == i) if homes else slice(None)
                g = of_order[k - 1][at]
                share[k - 1, at] = _look(gram, shares, k, g, 0.0)
                left[k - 1, at] = _look(context, lefts, k + ORDER, g >> BITS, 1.0)
        p = np.full(len(grams), 1.0 / (1 << BITS))
        for k in range(ORDER):
            p = share[k] + left[k] * p
        return p

    def log_ppl(self, code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean -log probability of each text's n-grams."""
        grams, back = np.unique(code, return_inverse=True)
        logs, size = -np.log(np.maximum(self.probabilities(grams), 1e-12)), np.diff(offsets)
        # summed text by text, so copies get the same
        return np.bincount(np.repeat(np.arange(len(size)), size), logs[back], len(size)) / np.maximum(size, 1)


def measure(docs: DataFrame, models: str) -> DataFrame:
    """doc_id, lang, a hash of the text, the statistics and log_ppl (nats a symbol, by the texts
    of its language's other fold; null without text or such a model) of each document."""
    key = os.urandom(8).hex()
    d = with_fold(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("_text")))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = schema_with(d.drop("text", "fold"), *[(x, "long") for x in fields], ("log_ppl", "double"))
    names = schema.names

    def model_of(name: str) -> Model | None:
        cache = worker_cache("quality")
        if key not in cache:
            cache.clear()
            cache[key] = Held(), {}
        held, found = cache[key]
        if name not in found:
            found[name] = Model.read(models, name, held)
        return found[name]

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(2))
            others = model_name(batch.column(1).to_pylist(), [(x + 1) % FOLDS for x in batch.column(4).to_pylist()])
            parts, ppl = [], np.full(batch.num_rows, np.nan)
            for lo, hi in T.chunks(off_all, _CHUNK):
                parts.append(statistics(buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]))
            size = np.diff(off_all)
            for name in dict.fromkeys(others):
                model = model_of(name)
                mine = np.flatnonzero(np.array([x == name for x in others]) & (size > 0)) if model else np.zeros(0, np.int64)
                ends = np.r_[0, np.cumsum(size[mine])]
                # a model in parts may be read anew for each chunk, so those are larger
                for lo, hi in T.chunks(ends, _CHUNK if model is None or model.parts == 1 else 4 * _CHUNK):
                    buf = np.concatenate([buf_all[off_all[i] : off_all[i + 1]] for i in mine[lo:hi].tolist()])
                    sym, off = symbols(buf, ends[lo : hi + 1] - ends[lo])
                    ppl[mine[lo:hi]] = model.log_ppl(codes(sym, off), off)
            cols = [pa.array(np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64)) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols, pa.array(ppl, pa.float64(), mask=np.isnan(ppl))], names=names)

    return d.mapInArrow(run, schema)


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """doc_id, the statistics, base_failed, log_ppl and kept of every document.

    The models and the bands are of all distinct texts, so copies don't draw them. A language's
    band comes from its texts of 50 words or more; a language with fewer than SOUND_TEXTS such
    has none, and what doesn't fail the base rules is kept. A null text has no words, all
    statistics 0 and fails; a null lang is a language of its own; an empty table gives
    none; repeated rows are judged each. Other columns are not read.
    """
    docs = docs.select("doc_id", "lang", "text")
    model = fit(count_ngrams(docs))
    d = written(measure(docs, model), "quality")
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sound = d.filter(F.col("n_words") >= 50)
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000)
    named = lambda x: x.withColumn("_l", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("null")))
    bands = named(sound).select("_l", "_text", "log_ppl").dropDuplicates(["_l", "_text"]).groupBy("_l").agg(q.alias("q"), F.count("*").alias("_n")).filter(F.col("_n") >= SOUND_TEXTS)
    far = lambda i, j: F.greatest(F.col("q")[j] - F.col("q")[i], F.lit(SPREAD))
    bands = bands.select("_l", (F.col("q")[1] - below * far(0, 1)).alias("lowest"), (F.col("q")[1] + above * far(1, 2)).alias("highest"))
    d = named(d).join(if_small(written(bands, "bands")), "_l", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("lowest"), F.col("highest")), F.lit(True))
    return d.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "lowest", "highest")
