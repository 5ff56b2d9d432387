"""Near-duplicates by SetSketch registers: banded, estimated jointly, verified on full sets.

A register is the truncated, exponentially spaced minimum of a set's hashes: registers of a
union are the maxima of the registers, and two sets' registers are equal the more often the
more the sets share. Bands of registers give candidates; the joint likelihood of how many
registers of a pair are above, below and equal gives an estimate of the Jaccard similarity;
those that may reach the threshold are compared on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm.components import components
from tabulon.llm.shared import release, schema_with, written

#: Bands and registers of each: two sets of similarity 0.8 share no band once in 16000 times.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Base of the register scale, rate of the exponentials, largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 4.5
#: Bands whose buckets are looked at in each turn. A large group is linked by its first bands, so
#: few of its members still differ in label when the others come.
TURNS = (1, 4, BANDS)
#: Numbers of 64 bits in which a set's parities are kept.
PARITIES = 32
#: Holders of a rare shingle that one block of them has.
HOLDERS = 256

_rng = np.random.Generator(np.random.PCG64(8128))
_MUL = _rng.integers(1, 2**31, REGISTERS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.int64).astype(np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[len(sets), REGISTERS] registers; no set may be empty."""
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    h = (np.concatenate(sets) >> T.U64(32)).astype(np.uint32)
    least = np.empty((len(sets), REGISTERS), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            x = h * _MUL[i] + _ADD[i]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            least[:, i] = np.minimum.reduceat(x, at)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """[n, BANDS] keys of the bands' register values."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(BANDS, dtype=T.U64), (len(reg), 1))
        wide = reg.astype(T.U64).reshape(len(reg), BANDS, ROWS)
        for k in range(ROWS):
            key = T.fmix(key * T.U64(0x9DDFEA08EB382D69) + wide[:, :, k] + T.U64(1))
    return key.view(np.int64)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of pairs that make their numbers of greater, less and equal registers
    likeliest, given the sets' sizes."""
    up, down = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(na)), most.copy()
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # golden section: the likelihood has one peak
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(x) > value(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, registers and band keys of each document."""

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(1))
            for lo, hi in T.chunks(off_all):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                sets = T.shingle_sets(buf, off, width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.int64)
                reg: list[bytes | None] = [None] * len(n)
                keys: list[np.ndarray | None] = [None] * len(n)
                if len(full):
                    some = [sets[i] for i in full]
                    r = registers(some)
                    k = band_keys(r)
                    with np.errstate(over="ignore"):
                        for i, s in zip(full.tolist(), some, strict=True):
                            sums[0, i] = T.fmix(s ^ T.U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=T.U64).view(np.int64)
                            sums[1, i] = T.fmix(s + T.U64(0x123456789ABCDEF1)).sum(dtype=T.U64).view(np.int64)
                    for j, i in enumerate(full.tolist()):
                        reg[i], keys[i] = r[j].tobytes(), k[j]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(reg, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "h1", "h2", "reg", "keys"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, schema_with(d.drop("text"), ("n_shingles", "long"), ("h1", "long"), ("h2", "long"), ("reg", "binary"), ("keys", "array<long>")))


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose estimate isn't clearly below the threshold."""
    floor = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("reg").alias(f"r{c}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            r = [np.stack([np.frombuffer(x, np.uint16) for x in batch.column(i).to_pylist()]) for i in (4, 5)]
            n = [np.asarray(batch.column(i)).astype(np.float64) for i in (2, 3)]
            able = np.minimum(*n) >= threshold * np.maximum(*n) - 1e-9
            keep = able & (estimate(*r, *n) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return d.mapInArrow(run, d.select("a", "b").schema)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * common >= percent * union."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    # rows of one doc_id are one document: a pair is linked if any of their texts is

    def run(batches):
        for batch in batches:
            (ba, oa), (bb, ob) = T.texts(batch.column(2)), T.texts(batch.column(3))
            keep = []
            for lo, hi in T.chunks(oa + ob):
                x, y = (T.shingle_sets(b[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], width) for b, o in ((ba, oa), (bb, ob)))
                for s, t in zip(x, y, strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(d.mapInArrow(run, d.select("a", "b").schema), "links", 500)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("doc"))
    return rows.join(labels.select(F.col("node").alias("doc"), F.col("component").alias("label")), "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets whose members differ in label."""
    keys = rows.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    return rows.join(keys, "key", "left_semi")


def parities(x: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES classes of hashes: whether a set has an odd number there.
    Two sets' bits differ where an odd number of what only one has falls, so the sets differ in
    as many elements at least, whatever else they share."""
    odd = np.bincount((x % T.U64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_rows(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """doc, s (the shingle set), own (its hash), n (its size) and odd (its parities) of each text
    of the members."""

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(1))
            for lo, hi in T.chunks(off_all):
                sets = T.shingle_sets(buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo], width)
                with np.errstate(over="ignore"):
                    own = np.array([T.fmix(x + T.U64(0x123456789ABCDEF1)).sum(dtype=T.U64) for x in sets], T.U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(own), pa.array([len(x) for x in sets], pa.int32()), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))], names=["doc", "s", "own", "n", "odd"])

    some = texts.select(F.col("doc_id").alias("doc"), "text").join(members.select("doc").distinct(), "doc", "left_semi")
    return written(some.mapInArrow(run, schema_with(some.select("doc"), ("s", "array<long>"), ("own", "long"), ("n", "int"), ("odd", "array<long>"))).dropDuplicates(["doc", "own", "n"]), "sets", 1000)


def low_bits(reps: DataFrame) -> DataFrame:
    """doc and bits: the low four bits of each register, sixteen registers a number."""

    def run(batches):
        for batch in batches:
            r = [np.frombuffer(x, np.uint16).astype(T.U64) & T.U64(15) for x in batch.column(1).to_pylist()]
            bits = [(x.reshape(-1, 16) << (T.U64(4) * np.arange(16, dtype=T.U64))).sum(1, dtype=T.U64).view(np.int64) for x in r]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["doc", "bits"])

    d = reps.select(F.col("doc_id").alias("doc"), "reg")
    return d.mapInArrow(run, schema_with(d.drop("reg"), ("bits", "array<long>")))


def _differing(a, b):
    """How many registers differ in their low bits."""
    total = F.lit(0)
    for i in range(REGISTERS // 16):
        y = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(y)
    return total


def rare_pairs(members: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (doc, label) of different labels that may reach the threshold.

    With the shingles of all members in one order, the rarest first, two sets that reach it
    share one of their first n - ceil(n * percent / 100) + 1 each; after the first that they
    share, both have enough left. Their sizes are near, their parities differ in no more places
    than their sets may in elements, and of their registers' low bits no more differ than SLACK
    allows. All that is tested within the join, so a large group gives
    pairs for what its members share beside what all have. Of a shingle's holders only those
    without its commonest label are compared with all, in blocks of HOLDERS.
    """
    sets = set_rows(members, texts, width)
    one = sets.select("doc", "own", "n", F.explode("s").alias("x"))
    df = one.groupBy("x").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("doc", "own").orderBy("df", "x"))
    first = one.join(df, "x").withColumn("nth", nth).filter((F.col("df") > 1) & (F.col("nth") <= F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1))
    odd = sets.select("doc", "own", "odd")
    first = written(first.select("doc", "own", "n", F.col("x").alias("key"), "nth").join(odd, ["doc", "own"]).drop("own").join(members.select("doc", "label").distinct(), "doc").join(low_bits(reps.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")), "doc"), "rare")
    release(sets)
    # a key's commonest label needs no comparison within itself: the others meet all, block by block
    by_label = first.groupBy("key", "label").agg(F.count("*").alias("c"))
    keys = by_label.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("c"), F.count("*").alias("labels")).filter("labels > 1")
    some = first.join(keys.select("key", "major", F.ceil(F.col("c") / HOLDERS).cast("int").alias("blocks")), "key")
    fields = ("doc", "label", "n", "nth", "bits", "odd", "minor")
    side = lambda d, c: d.select("key", "block", *[F.col(f).alias(f"{f}_{c}") for f in fields])
    some = some.withColumn("minor", F.col("label") != F.col("major"))
    asking = side(some.filter("minor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a")
    held = side(some.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "b")
    share = percent / 100
    off = (1 - share) * 15 / 16
    most = float(REGISTERS * off + SLACK * np.sqrt(REGISTERS * off * (1 - off)))
    na, nb = F.col("n_a"), F.col("n_b")
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    left = (100 + percent) * (1 + F.least(na - F.col("nth_a"), nb - F.col("nth_b"))) >= percent * (na + nb)
    apart = F.lit(0)
    for i in range(PARITIES):
        apart = apart + F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i))))
    alike = 100 * (na + nb - apart) >= percent * (na + nb + apart)
    once = ~F.col("minor_b") | (F.col("doc_a") < F.col("doc_b"))
    both = asking.join(held, ["key", "block"]).filter(once & (F.col("label_a") != F.col("label_b")) & near & left & alike & (_differing(F.col("bits_a"), F.col("bits_b")) <= most))
    return both.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def linked(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """node, component of the linked documents of ``reps`` (one of each distinct set); None
    where none is.

    In each turn every member of a bucket whose members differ in label is compared with one
    pivot of it; what that links shares a label from then on. The first turns look at few
    bands: a group of n costs n comparisons a bucket and turn at most, and far fewer once its
    first bands have linked it. Those who still differ from someone in a bucket after all turns
    are compared by the rare shingles that they share.
    """
    exploded = reps.select(F.col("doc_id").alias("doc"), F.posexplode("keys").alias("band", "key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rows = written(exploded.join(shared, "key", "left_semi"), "bands")
    # by shuffle at any size, once: who shares a bucket grows with the corpus
    texts = written(docs.join(rows.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    labels = None

    def take(pairs: DataFrame) -> None:
        nonlocal labels
        near = written(likely(pairs, reps, percent / 100), "likely")
        found = verified(near, texts, width, percent)
        release(near)
        if not found.isEmpty():
            # what is linked already comes as stars of its least members
            known = found if labels is None else found.union(labels.select("component", "node"))
            before, labels = labels, written(components(known), "labels")
            release(before)
        release(found)

    for turn, bands in enumerate(TURNS):
        some = rows if bands == BANDS else rows.filter(F.col("band") < bands)
        now = written(_mixed(_labelled(some, labels)), "mixed") if turn else some.withColumn("label", F.col("doc"))
        order = F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "label")
        pivots = now.groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.doc").alias("p"), F.col("p.label").alias("pl"))
        pairs = now.join(pivots, "key").filter("label <> pl").select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct()
        take(pairs)
        release(now if turn else None)
    mixed = written(_mixed(_labelled(rows, labels)).select("doc", "label").distinct(), "mixed")
    if not mixed.isEmpty():
        take(rare_pairs(mixed, reps, texts, width, percent))
    release(rows, texts, mixed)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Documents are linked when 100 * common >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable and kept tells whether that is its own.
    Texts with one set are one class from the start, however many; a null text or one
    without words has an empty set and is linked with nothing. A null doc_id is linked with
    nothing and kept; rows with one doc_id are one document and get one component; an empty
    table gives none. Columns other than doc_id and text aren't read.
    """
    docs = docs.select("doc_id", "text")
    all_rows = written(sketch(docs, width), "sketch", 2000)
    full = all_rows.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "h1", "h2", "n_shingles"), ["doc_id", "h1", "h2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    reps = written(reps.select("doc_id", "n_shingles", "reg", "keys"), "reps")
    labels = linked(reps, docs, width, percent)
    rows = all_rows.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left")
    rows = rows.withColumn("node", F.coalesce("rep", "doc_id"))
    if labels is not None:
        rows = rows.join(labels, "node", "left")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("long"))
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id")))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
