"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives each vocabulary piece a probability. A text is its words, lower-cased, each
after one space; a word's probability is the sum over all its segmentations into pieces, found
by the forward algorithm over the whole word however long, and a text's is the product over
its words. Probabilities are learned by expectation maximisation over the same lattice.
"""

from __future__ import annotations

import os
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textops as T
from tabulon.llm.shared import if_small, release, schema_with, vocabulary, worker_cache, written

#: Labelled documents a language is fitted on, about: those whose seeded hash is below its share.
FIT_DOCS = 400
#: Words up to so many bytes are taken many at a time as matrices, longer ones one by one.
WIDE = 512
#: Positions between two rescalings of the forward sums.
EVERY = 16
#: Languages that are scored at once, and words whose likelihoods a worker keeps.
GROUP, HELD = 64, 200_000
_BASE = T.U64(0x100000001B3)
_CHUNK = 2 << 20


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces as bytes with a space for the word mark, and every single byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            x = sp.id_to_piece(i).replace("▁", " ").encode()
            found.add(bytes(T.LOWER[np.frombuffer(x, np.uint8)]))
    return sorted(found)


class Lattice:
    """Finds pieces in words by hashes of byte substrings."""

    def __init__(self, pieces: list[bytes]):
        size = np.array([len(x) for x in pieces])
        h = np.zeros(len(pieces), T.U64)
        self.lengths = np.unique(size).tolist()
        with np.errstate(over="ignore"):
            for n in self.lengths:
                at = np.flatnonzero(size == n)
                m = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), n).astype(T.U64) + T.U64(1)
                k = np.zeros(len(at), T.U64)
                for j in range(n):
                    k = k * _BASE + m[:, j]
                h[at] = T.fmix(k)
        self.order = np.argsort(h).astype(np.int32)
        self.keys = h[self.order]
        self.n = len(pieces)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> T.U64(44)).astype(np.int64)] = True

    def places(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """words: [W, n] bytes. (length, the piece at each place of each word or ``self.n``
        where there is none, [n - length + 1, W]; how many there are by place)."""
        count, n = words.shape
        h = np.zeros((n + 1, count), T.U64)
        out = []
        with np.errstate(over="ignore"):
            wide = words.T.astype(T.U64) + T.U64(1)
            for j in range(n):
                h[j + 1] = h[j] * _BASE + wide[j]
            power, at = T.U64(1), 0
            for length in self.lengths:
                if length > n:
                    break
                for _ in range(length - at):
                    power *= _BASE
                at = length
                f = T.fmix(h[length:] - h[:-length] * power)
                some = np.flatnonzero(self.maybe[(f >> T.U64(44)).astype(np.int64)])
                wanted = f.ravel()[some]
                k = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
                hit = self.keys[k] == wanted
                if hit.any():
                    found = np.full(f.shape, self.n, np.int32)
                    found.ravel()[some[hit]] = self.order[k[hit]]
                    out.append((length, found, (found < self.n).sum(1)))
        return out

    def _edges(self, words: np.ndarray):
        """Starts, lengths, words and pieces of all edges, by their ends; and n + 2 offsets in
        them, by end."""
        n = words.shape[1]
        parts = []
        for length, k, _ in self.places(words):
            i, w = np.nonzero(k < self.n)
            parts.append((i + length, i, w, k[i, w]))
        end, start, word, piece = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        order = np.argsort(end, kind="stable")
        return start[order], word[order], piece[order], np.searchsorted(end[order], np.arange(n + 2))

    def forward(self, words: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[W, L] log probabilities of words under p, which is [n + 1, L] with zeros at last.
        Word w has its first sizes[w] bytes; sizes ascend."""
        count, n = words.shape
        if count == 1 and n > WIDE:
            return self._forward_one(words, p)
        found = self.places(words)
        a = np.zeros((n + 1, count, p.shape[1]))
        a[0] = 1.0
        scale, out = np.zeros((count, p.shape[1])), np.zeros((count, p.shape[1]))
        cut = np.searchsorted(sizes, np.arange(n + 2))
        for j in range(1, n + 1):
            row, lo = a[j], cut[j]
            for length, k, some in found:
                i = j - length
                if i < 0:
                    break
                if 4 * some[i] > count:
                    row[lo:] += a[i, lo:] * p[k[i, lo:]]
                elif some[i]:
                    w = np.flatnonzero(k[i] < self.n)
                    row[w] += a[i, w] * p[k[i, w]]
            if cut[j + 1] > lo:
                out[lo : cut[j + 1]] = np.log(np.maximum(row[lo : cut[j + 1]], 1e-300)) + scale[lo : cut[j + 1]]
            lo = cut[j + 1]
            if j % EVERY == 0 and lo < count:
                s = np.maximum(row[lo:], 1e-300)
                a[max(0, j - self.lengths[-1]) : j + 1, lo:] /= s.copy()
                scale[lo:] += np.log(s)
        return out

    def _forward_one(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        start, _, piece, cut = self._edges(words)
        with np.errstate(divide="ignore"):
            lp = np.log(p)
        la, at = np.zeros((words.shape[1] + 1, p.shape[1])), cut.tolist()
        for j in range(1, len(la)):
            x = la[start[at[j] : at[j + 1]]] + lp[piece[at[j] : at[j + 1]]]
            m = x.max(0)
            la[j] = m + np.log(np.exp(x - m).sum(0))
        return la[-1:]

    def expected(self, words: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` copies of each word; words of one length."""
        count, n = words.shape
        start, word, piece, cut = self._edges(words)
        with np.errstate(divide="ignore"):
            lp = np.log(p)[piece]
        end = np.repeat(np.arange(n + 1), np.diff(cut))
        if count == 1:
            la, lb = self._both_one(start.tolist(), lp.tolist(), cut.tolist(), end.tolist(), n)
        else:
            la, lb = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
            la[0] = lb[n] = 0.0
            for j in range(1, n + 1):
                e = slice(cut[j], cut[j + 1])
                np.logaddexp.at(la[j], word[e], la[start[e], word[e]] + lp[e])
            by_start = np.argsort(start, kind="stable")
            back = np.searchsorted(start[by_start], np.arange(n + 1))
            for i in range(n - 1, -1, -1):
                e = by_start[back[i] : back[i + 1]]
                np.logaddexp.at(lb[i], word[e], lb[end[e], word[e]] + lp[e])
        share = np.exp(la[start, word] + lp + lb[end, word] - la[n][word]) * counts[word]
        return np.bincount(piece, share, self.n + 1)

    @staticmethod
    def _both_one(start: list, lp: list, cut: list, end: list, n: int):
        """Forward and backward sums of one long word, as logarithms."""
        la, lb = [0.0] * (n + 1), [-np.inf] * n + [0.0]
        for j in range(1, n + 1):
            x = [la[start[e]] + lp[e] for e in range(cut[j], cut[j + 1])]
            m = max(x)
            la[j] = m + log(sum([exp(y - m) for y in x]))
        for j in range(n, 0, -1):  # all edges from j on are in lb[j] by now
            for e in range(cut[j], cut[j + 1]):
                x, y = lb[start[e]], lb[j] + lp[e]
                lb[start[e]] = y if x < y - 700 else x + log(1 + exp(y - x)) if x > y else y + log(1 + exp(x - y))
        return np.array(la)[:, None], np.array(lb)[:, None]


def matrices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False):
    """Words as byte matrices with a leading space, their sizes with it and their places. Those
    of near lengths (one length where ``exact``) stand together, the shorter before the longer."""
    size = ends - starts + 1
    width = size if exact else np.where(size <= 32, size, np.where(size <= WIDE, -(-size // 32) * 32, size))
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(width[order], prepend=-1))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
        n = int(width[order[a]])
        step = max(1, 400_000 // n) if n <= WIDE else 1
        for lo in range(a, b, step):
            at = order[lo : min(lo + step, b)]
            own = np.arange(n - 1)
            inside = own < (size[at] - 1)[:, None]
            m = np.full((len(at), n), 32, np.uint8)
            m[:, 1:] = np.where(inside, T.LOWER[buf[np.minimum(starts[at][:, None] + own, len(buf) - 1)]], 0)
            yield at, m, size[at]


def fit(words: list[bytes], counts: np.ndarray, lattice: Lattice, single: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Piece probabilities of one language from its words and how often each occurs."""
    offsets = np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    p = np.full(lattice.n + 1, 1.0 / lattice.n)
    p[-1] = 0
    for _ in range(rounds):
        c = np.where(single, 0.05, 0.0005)
        for at, m, _ in matrices(buf, offsets[:-1], offsets[1:], exact=True):
            c = c + lattice.expected(m, counts[at], p)[:-1]
        p = np.r_[c / c.sum(), 0.0]
    return p


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


class Scorer:
    """Log likelihoods of texts in some languages; a worker keeps those of words it has met."""

    def __init__(self, pieces: list[bytes], p: np.ndarray):
        self.lattice, self.p = Lattice(pieces), p
        self.keys, self.logs = np.zeros(0, T.U64), np.zeros((0, p.shape[1]))

    def words(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[W, L] of words, h: their sorted distinct hashes."""
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        out = np.zeros((len(h), self.p.shape[1]))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            for k, m, sizes in matrices(buf, starts[new], ends[new]):
                out[new[k]] = self.lattice.forward(m, sizes, self.p)
            if len(self.keys) + len(new) > HELD:
                self.keys, self.logs, new = np.zeros(0, T.U64), self.logs[:0], np.arange(min(len(h), HELD))
            keys = np.r_[self.keys, h[new]]
            order = np.argsort(keys)
            self.keys, self.logs = keys[order], np.concatenate([self.logs, out[new]])[order]
        return out

    def texts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        starts, ends, before = T.spans(buf, off, T.IS_WS)
        h, at, back = np.unique(T.span_hashes(buf, starts, ends, True), return_index=True, return_inverse=True)
        total = np.zeros((len(back) + 1, self.p.shape[1]))
        np.cumsum(self.words(h, buf, starts[at], ends[at])[back], axis=0, out=total[1:])
        return total[before[1:]] - total[before[:-1]]


def _lattice(path: str) -> tuple[Lattice, np.ndarray, list[bytes]]:
    held = worker_cache("lattice")
    if path not in held:
        pieces = load_pieces(path)
        held[path] = Lattice(pieces), np.array([len(x) == 1 for x in pieces]), pieces
    return held[path]


def word_counts(sample: DataFrame) -> DataFrame:
    """lang, word (its lower-cased bytes) and n of the sample's texts."""

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(1))
            for lo, hi in T.chunks(off_all, _CHUNK):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                starts, ends, before = T.spans(buf, off, T.IS_WS)
                h = T.span_hashes(buf, starts, ends, True)
                raw = T.LOWER[buf].tobytes()
                langs = batch.column(0).slice(lo, hi - lo).to_pylist()
                for lang in dict.fromkeys(langs):
                    mine = np.concatenate([np.arange(before[d], before[d + 1]) for d in range(hi - lo) if langs[d] == lang])
                    _, at, n = np.unique(h[mine], return_index=True, return_counts=True)
                    at = mine[at]
                    words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """lang and p (its piece probabilities, doubles) of each language, in a written table.

    A language is fitted on about ``fit_docs`` whole texts: of its rows those whose hash of
    doc_id is below fit_docs by their number, so no language's rows meet in one task before
    they are few. Its expectation maximisation runs in one task, over its distinct words.
    labelled: doc_id, text, lang; rows with a null in one of them aren't used, and of rows with
    one doc_id the least text is.
    """
    path = path or vocabulary("piece_bpe_32k.model")
    rows = labelled.select("doc_id", "text", "lang").dropna()
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / float(1 << 53)
    sample = rows.join(if_small(sizes), "lang").filter(u * F.col("_n") < fit_docs)
    sample = written(sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "sample")

    def of_lang(pdf: pd.DataFrame) -> pd.DataFrame:
        lattice, single, _ = _lattice(path)
        pdf = pdf.sort_values("word")
        p = fit(pdf["word"].tolist(), pdf["n"].to_numpy(np.float64), lattice, single)
        return pd.DataFrame([(pdf["lang"].iloc[0], p.tobytes())], columns=["lang", "p"])

    model = written(word_counts(sample).groupBy("lang").applyInPandas(of_lang, "lang string, p binary"), "language-model")
    release(sample, sizes)
    return model


def _groups(model: DataFrame):
    """The model's languages in order of name, GROUP at a time: their names and [n + 1, L]."""
    langs, columns = [], []
    for r in model.orderBy("lang").toLocalIterator():
        langs.append(r["lang"])
        columns.append(np.frombuffer(r["p"], np.float64))
        if len(langs) == GROUP:
            yield langs, np.stack(columns, 1)
            langs, columns = [], []
    if langs:
        yield langs, np.stack(columns, 1)


def identify(docs: DataFrame, model: DataFrame, path: str | None = None) -> DataFrame:
    """docs plus lang_pred and score, from ``text`` alone.

    ``lang_pred`` is the language under which the whole text is likeliest (ties: the first by
    name) and ``score`` its share of the likelihoods; a text that is null or has no letter is
    ``und`` with score 0, as is every text where nothing was learned. An empty table gives
    none, repeated rows get the same. Columns of docs with these names are replaced. Languages
    are scored GROUP at a time, so executors hold some 16 MB of model at once for each group,
    however many languages there are.
    """
    path = path or vocabulary("piece_bpe_32k.model")
    docs = docs.drop("lang_pred", "score", "_best", "_top", "_all")
    d = docs.select("*", F.lit(None).cast("string").alias("_best"), F.lit(None).cast("double").alias("_top"), F.lit(None).cast("double").alias("_all"))
    at = docs.columns.index("text")
    for langs, p in _groups(model):
        d = _scored(d, at, langs, p, path)
    found = F.col("_best").isNotNull()
    return d.select(*docs.columns, F.coalesce("_best", F.lit("und")).alias("lang_pred"), F.when(found, F.exp(F.col("_top") - F.col("_all"))).otherwise(0.0).alias("score"))


def _scored(d: DataFrame, at: int, langs: list[str], p: np.ndarray, path: str) -> DataFrame:
    """d with its best language, its log likelihood and the log of the sum of all, after those
    of ``langs``."""
    shared, key = d.sparkSession.sparkContext.broadcast(p), os.urandom(8).hex()
    names = d.columns
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def scorer() -> Scorer:
        held = worker_cache("langid")
        if key not in held:
            if len(held) > 1:
                held.clear()
            held[key] = Scorer(load_pieces(path), shared.value)
        return held[key]

    def run(batches):
        for batch in batches:
            buf_all, off_all = T.texts(batch.column(at))
            best, top, total = (batch.column(i).to_pylist() for i in (-3, -2, -1))
            for lo, hi in T.chunks(off_all, _CHUNK):
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                ll = scorer().texts(buf, off)
                letters = np.r_[0, np.cumsum(ascii_letter[buf])]
                plain = letters[off[1:]] - letters[off[:-1]]
                most = ll.max(1)
                logs = most + np.log(np.exp(ll - most[:, None]).sum(1))
                for k in range(hi - lo):
                    if not (plain[k] or has_letter(buf[off[k] : off[k + 1]].tobytes())):
                        continue
                    i = lo + k
                    total[i] = float(logs[k]) if total[i] is None else float(np.logaddexp(total[i], logs[k]))
                    if top[i] is None or most[k] > top[i]:
                        best[i], top[i] = langs[int(ll[k].argmax())], float(most[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())], names=names)

    return d.mapInArrow(run, d.schema)
