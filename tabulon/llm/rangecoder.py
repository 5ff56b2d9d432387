"""Adaptive context-mixing range coder for token ids, many blocks in lock-step.

Each block is coded by itself. In a block an id is known by its slot, its rank among the ids
that the block holds. Three models predict the next slot: order 2 (a candidate for the hash of
the two slots before, with a confidence), order 1 (the same for the slot before) and order 0
(counts of the slots that neither candidate gave). The chance that the order-2 candidate is
right is a mix of what its own confidence and what the order-1 model say, with a weight that
moves to whichever was nearer; then comes the order-1 candidate, then order 0. Candidates move
with each id; chances and weights are learned from all ids before, every EVERY ids, so that a
step looks them up by confidences. A block begins with its ids and counts of order 0, as bits.
All arithmetic is on integers, so any machine decodes what another encoded. Blocks are lanes of
arrays: step t codes id t of every block at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids of a block and blocks coded together.
BLOCK, LANES = 4096, 1536
#: Least number of steps between two turns of learning.
EVERY = 64
ONE = 1 << 15
_S15, _S32 = np.uint64(15), np.uint64(32)
#: Ranges below this take in the next word.
_BOT = np.uint64(1 << 32)
_HASH = 4096
#: Bits that hold a place among the counts of a block, of which there are at most BLOCK.
_ROW = 12
_LEAST, _MOST = 512, ONE - 512
#: What a table holds where it has seen nothing: a slot that no block has, no confidence.
_EMPTY = 0xFFFC
#: Chances to begin with, and how many ids they are worth: by order 2's confidence; by order 1's
#: and whether both give the same candidate; of order 1's own candidate.
_A = np.array([2000, 9000, 16000, 24000])
_B = np.array([[1000, 2000], [4000, 14000], [8000, 20000], [12000, 26000]])
_C = np.array([500, 4000, 8000, 14000])
_WORTH = 16
#: A weight moves by at most _FAST, and by the errors of a turn / 2 ** _SLOW.
_SLOW, _FAST = 26, 24


class _Model:
    """Tables of n blocks and the prediction both directions share."""

    def __init__(self, n: int):
        self.n, self.lane = n, np.arange(n, dtype=np.int64)
        self.seen_a, self.seen_b, self.seen_c = (np.zeros((2, *x.shape, n), np.int64) for x in (_A, _B, _C))
        self.w = np.full(n, 128, np.int64)
        self.kinds = np.zeros(n, np.int64)
        self.counts = np.zeros((n, BLOCK), np.uint16)

    def begin(self) -> None:
        """Empty candidates, times 4, with their confidences: of order 1, then of order 2."""
        each = int(self.kinds.max())
        self.table = np.full(self.n * (each + _HASH), _EMPTY, np.uint16)
        self.base1, self.base2 = self.lane * each, self.n * each + self.lane * _HASH

    def sums(self, m: int) -> None:
        """Order-0 sums of the first m blocks."""
        self.width = width = int(self.kinds[:m].max()) + 1
        self.cum = np.zeros((m, width), np.int32)
        np.cumsum(self.counts[:m, : width - 1], axis=1, dtype=np.int32, out=self.cum[:, 1:])
        self.known, self.total = self.kinds[:m].copy(), self.cum[:, -1].astype(np.int64)
        self.flat = self.cum.ravel()
        self.place = None

    def find(self, row: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places of the last sums that aren't above v, in the rows that begin at ``row``."""
        if self.place is None:
            place, width = np.zeros((len(self.total), BLOCK), np.uint16), self.width - 1
            each = np.tile(np.arange(width, dtype=np.uint16), len(self.total))
            place[np.arange(BLOCK) < self.total[:, None]] = np.repeat(each, self.counts[: len(self.total), :width].ravel())
            self.place = place.ravel()
        return row + self.place.take(v, mode="clip")

    def chances(self) -> tuple[np.ndarray, np.ndarray]:
        """By context (confidences of order 2 and 1, whether their candidates are the same) and
        block: where the part of ONE of the order-2 candidate ends, and that of order 1."""
        a, b, c = ((hits * ONE + p[..., None] * _WORTH) // (n + _WORTH) for (n, hits), p in ((self.seen_a, _A), (self.seen_b, _B), (self.seen_c, _C)))
        self.gap = a[:, None, None] - b
        self.hit2 = np.clip((self.w * self.gap >> 8) + b, _LEAST, _MOST)
        self.hit2[0] = 0
        hit1 = (ONE - self.hit2) * np.clip(c, _LEAST, _MOST)[:, None] >> 15
        hit1[:, 0] = 0
        hit1[1:, :, 1] = 0
        return self.hit2.ravel(), (self.hit2 + hit1).ravel()

    def learn(self, context: np.ndarray, chosen: np.ndarray) -> None:
        """Learn from contexts and what was coded in them: 2, 1 or 0 (neither candidate)."""
        size = 32 * self.n
        h0, h1, h2 = np.bincount((chosen * np.int64(size) + context).ravel(), minlength=3 * size).reshape(3, 4, 4, 2, self.n)
        free = h0 + h1
        n = free + h2
        pull = (self.gap * ((h2 << 15) - n * self.hit2))[1:].sum((0, 1, 2)) >> _SLOW
        self.w = np.clip(self.w + np.clip(pull, -_FAST, _FAST), 16, 240)
        free[1:, :, 1] = 0
        for seen, x, hits in ((self.seen_a, n.sum((1, 2)), h2.sum((1, 2))), (self.seen_b, n[1:].sum(0), h2[1:].sum(0)), (self.seen_c, free.sum((0, 2)), h1.sum((0, 2)))):
            seen[0] += x
            seen[1] += hits


def _turns(steps: int):
    """First steps and numbers of steps between two turns of learning, which grow."""
    t = 0
    while t < steps:
        k = min(max(t >> 2, EVERY) // EVERY * EVERY, 4 * EVERY, steps - t)
        yield t, k
        t += k


def _moved(x: np.ndarray, n: np.ndarray, hit: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Table entries x, of confidence n, after slots s."""
    other = np.where(n > 1, x - n, s << 2)
    other += 1
    return np.where(hit, x + (n < 3), other)


def _head(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ids in ascending order (by high parts, one bit an id and one a step, and low parts) and
    their counts (a bit for each, set where an id begins)."""
    n, total = len(ids), int(counts.sum())
    low = (65536 // n).bit_length() - 1
    bits = np.zeros(total + n + (65536 >> low) + n * low, np.uint8)
    bits[np.cumsum(counts) - counts] = 1
    bits[total + (ids >> low) + np.arange(n)] = 1
    if low:
        bits[len(bits) - n * low :] = (ids[:, None] >> np.arange(low) & 1).ravel()
    return struct.pack("<HH", n - 1, total - 1) + np.packbits(bits).tobytes()


def _read_head(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, counts and the bytes that they take."""
    n, total = (x + 1 for x in struct.unpack("<HH", raw[:4]))
    low = (65536 // n).bit_length() - 1
    high = total + n + (65536 >> low)
    size = 4 + -(-(high + n * low) // 8)
    if total > BLOCK or n > total or size > len(raw):
        raise ValueError("a block is damaged")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size - 4, 4))
    first, top = np.flatnonzero(bits[:total]), np.flatnonzero(bits[total:high])
    if len(first) != n or len(top) != n or first[0]:
        raise ValueError("a block is damaged")
    ids = top - np.arange(n) << low
    if low:
        part = np.zeros((n, 16), np.uint8)
        part[:, :low] = bits[high : high + n * low].reshape(n, low)
        ids += np.packbits(part, bitorder="little").view("<u2")
    return ids.astype(np.uint16), np.diff(first, append=total), size


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of blocks of at most BLOCK ids below 65536, longest first."""
    n, steps = len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    flow, kinds = np.zeros((n, steps), np.uint16), []
    there, rank = np.zeros(65536, bool), np.zeros(65536, np.uint16)
    for k, b in enumerate(blocks):
        there[b] = True
        ids = np.flatnonzero(there)
        there[ids] = False
        rank[ids] = np.arange(len(ids))
        rank.take(b, out=flow[k, : len(b)], mode="wrap")
        kinds.append(ids)
    model = _Model(n)
    model.kinds[:] = [len(x) for x in kinds]
    model.begin()
    parts = [_predict(model, flow, sizes, t, k) for t, k in _turns(steps)]
    model.sums(n)
    totals = model.total.astype(np.uint64)

    low, rng = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    out, pos = np.zeros((n, steps + 4), np.uint32), np.zeros(n, np.int64)

    def carry(k):
        at = pos[k] - 1
        while len(k):
            out[k, at] += 1
            on = out[k, at] == 0
            k, at = k[on], at[on] - 1

    m, t = n, 0
    for start, stop, lanes, slots, ends in parts:
        for i in range(len(start)):
            if sizes[m - 1] <= t:
                m = int((sizes > t).sum())
            t += 1
            r = rng[:m] >> _S15
            add = r * start[i, :m]
            r *= stop[i, :m]
            r -= add
            at = lanes[ends[i] : ends[i + 1]].astype(np.int64)
            if len(at):
                j = slots[ends[i] : ends[i + 1]].astype(np.int64)
                below = model.flat.take(j)
                over = add.take(at)
                unit = (rng.take(at) - over) // totals.take(at)
                add[at] = over + unit * below.astype(np.uint64)
                r[at] = unit * (model.flat.take(j + 1) - below).astype(np.uint64)
            now = low[:m]
            now += add
            over = (now < add).nonzero()[0]
            if len(over):
                carry(over)
            rng[:m] = r
            need = (r < _BOT).nonzero()[0]
            if len(need):
                x, at = now.take(need), pos.take(need)
                out[need, at] = x >> _S32
                pos[need] = at + 1
                now[need] = x << _S32
                rng[need] = r.take(need) << _S32
    last = low + np.uint64(2**32 - 1)
    carry(np.flatnonzero(last < low))
    out[model.lane, pos] = last >> _S32
    pos += 1
    return [_head(ids, model.counts[k, : len(ids)].astype(np.int64)) + out[k, : pos[k]].astype("<u4").tobytes() for k, ids in enumerate(kinds)]


def _predict(model: _Model, flow: np.ndarray, sizes: np.ndarray, t: int, k: int):
    """For k steps from t: where the parts of ONE that were coded begin and end; blocks that
    neither candidate served and the places of their slots among the sums, by step."""
    m = int((sizes > t).sum())
    s = np.zeros((k + 2, m), np.uint16)
    s[max(0, 2 - t) :] = flow[:m, max(0, t - 2) : t + k].T
    before, s = s[:-1].astype(np.int64), s[2:]
    at = np.empty((k, 2, m), np.int64)
    np.add(before[1:], model.base1[:m], out=at[:, 0])
    np.add(before[:-1] * 2477 + before[1:] * 31 & _HASH - 1, model.base2[:m], out=at[:, 1])
    found, hits = np.empty((k, 2, m), np.uint16), np.empty((k, 2, m), bool)
    table = model.table
    for i, j, x, hit in zip(s, at, found, hits, strict=True):
        table.take(j, out=x, mode="wrap")
        np.equal(x >> 2, i, out=hit)
        table[j] = _moved(x, x & 3, hit, i)
    is2, is1 = hits[:, 1], hits[:, 0]
    is1 &= ~is2
    sure = found & 3
    key = (sure[:, 1] << 3) + (sure[:, 0] << 1) + (found[:, 0] >> 2 == found[:, 1] >> 2)
    context = np.multiply(key, model.n, dtype=np.int64) + model.lane[:m]
    one, two = (x.astype(np.uint16).take(context) for x in model.chances())
    neither = ~(is2 | is1)
    start = np.where(is2, np.uint16(0), np.where(is1, one, two))
    stop = np.where(is2, one, np.where(is1, two, np.uint16(ONE)))
    model.learn(context, 2 * is2.view(np.uint8) + is1)
    neither &= np.arange(t, t + k)[:, None] < sizes[:m]
    lanes, slots = np.broadcast_to(model.lane[:m], (k, m))[neither], s[neither].astype(np.int64)
    np.add.at(model.counts.reshape(-1), lanes * BLOCK + slots, np.uint16(1))
    slots += lanes * (int(model.kinds.max()) + 1)
    return start, stop, lanes.astype(np.int32), slots.astype(np.int32), [0, *np.cumsum(np.count_nonzero(neither, axis=1)).tolist()]


def decode_blocks(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """Inverse of encode_blocks; sizes: ids of each block, descending."""
    n, steps = len(coded), int(sizes[0])
    model = _Model(n)
    width = max(map(len, coded)) // 4 + 4
    words, kinds = np.zeros((n, width), np.uint32), []
    for k, x in enumerate(coded):
        ids, counts, at = _read_head(x)
        kinds.append(ids)
        model.kinds[k] = len(ids)
        model.counts[k, : len(ids)] = counts
        words[k, : (len(x) - at) // 4] = np.frombuffer(x, "<u4", (len(x) - at) // 4, at)
    model.begin()
    model.sums(n)
    code, rng = words[:, 0].astype(np.uint64) << _S32 | words[:, 1], np.full(n, 2**64 - 1, np.uint64)
    pos, words = model.lane * width + 2, words.ravel()
    p1, g = np.zeros(n, np.int64), np.zeros(n, np.int64)
    table, flat, totals, out = model.table, model.flat, model.total.astype(np.uint64), np.zeros((steps, n), np.uint16)
    with np.errstate(divide="ignore"):  # of damaged blocks
        for t, k in _turns(steps):
            m = int((sizes > t).sum())
            code, rng, pos, p1, g = code[:m], rng[:m], pos[:m], p1[:m], g[:m]
            lane, base1, base2 = model.lane[:m], model.base1[:m], model.base2[:m]
            one, two = (x.astype(np.uint64) for x in model.chances())
            context, chosen = np.empty((k, m), np.int64), np.empty((k, m), np.uint8)
            at2, x = np.empty((2, m), np.int64), np.empty((2, m), np.uint16)
            for i in range(k):
                np.add(p1, base1, out=at2[0])
                g += p1 * 31
                g &= _HASH - 1
                np.add(g, base2, out=at2[1])
                np.multiply(p1, 2477, out=g)
                table.take(at2, out=x, mode="wrap")
                sure, c = x & 3, x >> 2
                key = sure[1] << 2
                key += sure[0]
                key <<= 1
                key += c[0] == c[1]
                own = context[i]
                np.multiply(key, n, out=own)
                own += lane
                r = rng >> _S15
                end2, end1 = one.take(own, mode="wrap"), two.take(own, mode="wrap")
                end2 *= r
                end1 *= r
                is2, hit = code < end2, code < end1
                np.add(is2.view(np.uint8), hit.view(np.uint8), out=chosen[i])
                s = np.where(is2, c[1], c[0])
                below = np.where(hit, end2, end1)
                below[is2] = 0
                rng = np.where(is2, end2, np.where(hit, end1, rng))
                rng -= below
                code -= below
                at = (~hit).nonzero()[0]
                if len(at):
                    unit, v = rng.take(at) // totals.take(at), code.take(at)
                    row = at * model.width
                    j = model.find(row, (v // unit).view(np.int64) + (at << _ROW))
                    lo = flat.take(j, mode="wrap")
                    code[at] = v - unit * lo.astype(np.uint64)
                    rng[at] = unit * (flat.take(j + 1, mode="wrap") - lo).astype(np.uint64)
                    s[at] = j - row
                need = (rng < _BOT).nonzero()[0]
                if len(need):
                    j = pos.take(need)
                    code[need] = code.take(need) << _S32 | words.take(j, mode="wrap")
                    rng[need] = rng.take(need) << _S32
                    pos[need] = j + 1
                table[at2] = _moved(x, sure, c == s, s)
                p1 = s.astype(np.int64)
                out[t + i, :m] = s
            model.learn(context, chosen)
    out = np.ascontiguousarray(out.T)
    return [ids.take(out[k, : sizes[k]], mode="wrap") for k, ids in enumerate(kinds)]
