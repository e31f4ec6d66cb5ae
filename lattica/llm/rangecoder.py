"""Adaptive context-mixing range coder for token ids, many blocks at once.

A sequence of ids is cut into blocks of BLOCK ids. Every block starts from the same model state and has a checksum of its
own, so any block can be decoded alone. A model predicts the next id from three orders, all of which adapt in each block:

* order 2 and order 1: a hashed slot of the last two ids, and of the last one, holds the id that followed, a confidence, and a
  check of its context. How far a confidence is believed (and a slot of another context, confidence 0) is learnt as a probability;
* order 0: adaptive frequencies of GROUPS groups of ids, which learn from the ids that the higher orders miss; within its
  group an id has its share in the prior.

The orders are mixed: whether the next id is a candidate is coded with the probability that a logistic mix of the orders gives,
squash(sum of weights * stretch(probability of each order)), first for the candidate of order 2 (an order 1 that names the
same id speaks for it, one that names another against it), then, if that is another, for that of order 1. The weights are
learnt by gradient in each block. What is neither is coded by order 0. All of it is integer arithmetic on tables, so that every machine
gets the same numbers.

A prior (frequencies of the ids that occur, and the commonest successor of each slot) is where blocks start from; it is
stored once a sequence. Steps go to a 64-bit range coder with 16-bit output; a carry is added to the words that are out.
The blocks are lanes of numpy arrays that step together, so a step is some dozens of array operations for all of them.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

U = np.uint64
#: Ids of a block; fewer where a sequence is short, so that it still has many blocks in step.
BLOCK, LEAST, LANES = 4096, 256, 2048
VOCAB = 1 << 16
T1, T2 = 1 << 10, 1 << 11
#: Bounds of a mixed probability of 2^16, groups of order 0, the least share of a group of 2^16,
#: how slowly groups adapt, and the bits beyond 2^16 that their shares are kept in (rounding then never empties a group).
FEWEST, MOST = 64, 57344
GROUPS, FLOOR, RATE, FINE = 64, 64, 8, 6
LOW40 = U(1 << 40)
#: Bound of a weight, at which the sums of inputs still fit 32 bits.
MOST_WEIGHT = 1 << 18
#: ln(p / (1 - p)) * 256 of p in 4096ths, and the 2^16ths of 1 / (1 + exp(-x / 256)) for x from -2047.
STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int32)
SQUASH = np.array([min(MOST, max(FEWEST, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
#: What the cumulative shares of groups move to when a group comes, [group, edge].
_EDGE = np.arange(GROUPS + 1)
#: By whether order 1 names the id of order 2; by a confidence, what a hit adds; what a probability moves to, by hit.
SIGN, RAISE, HIT = np.array([-1, 1], np.int32), np.minimum(15 - np.arange(16), 2).astype(np.int32), np.array([32, MOST - 32], np.int32)
MIXIN = np.where(_EDGE[None, :] <= np.arange(GROUPS)[:, None], _EDGE * FLOOR, 65536 - (GROUPS - _EDGE) * FLOOR).astype(np.int32) << FINE


def _contexts(ids: np.ndarray, order: int, at: int, end: int) -> np.ndarray:
    """check << bits of a slot | slot, in an order, of the ids from at to end."""
    a, b = (np.concatenate([np.zeros(max(0, min(end, k) - at), np.int64), ids[max(0, at - k) : max(0, end - k)].astype(np.int64)]) for k in (1, 2))
    return a * 40503 >> 4 & (T1 << 8) - 1 if order == 1 else a * 40503 + b * 60493 >> 5 & (T2 << 8) - 1


def _commonest(ids: np.ndarray, order: int, slots: int, step: int = 1 << 18, parts: int = 8) -> np.ndarray:
    """Of each slot of an order, check << 16 | id of the commonest successor. Slots are sorted in parts; beside the ids, 4 bytes an id are held and a part."""
    n = len(ids)
    context = np.empty(n, np.uint32)
    for at in range(0, n, step):
        context[at : at + step] = _contexts(ids, order, at, min(at + step, n))
    out = np.zeros(slots, np.int32)
    for part in range(parts):
        pair = []
        for at in range(0, n, step):
            c = context[at : at + step]
            on = np.flatnonzero(c & np.uint32(parts - 1) == part)
            pair.append((c[on] // np.uint32(parts) << np.uint32(16)) | ids[at : at + step][on].astype(np.uint32))
        pair = np.concatenate(pair)
        if not len(pair):
            continue
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        times, pair = np.diff(first, append=len(pair)), pair[first].astype(np.int64)
        last = pair[np.lexsort((pair, times))]  # the last write of a slot is its commonest successor
        c = (last >> 16) * parts + part
        out[c % slots] = c // slots << 16 | last & 0xFFFF
    return out


class Prior:
    """What blocks start from: order-0 frequencies that sum to 2^16 and a first prediction of each slot (check << 16 | id)."""

    def __init__(self, freq: np.ndarray, first1: np.ndarray, first2: np.ndarray):
        self.freq, self.first1, self.first2 = freq.astype(np.int64), first1, first2
        # Groups of about equal frequency, commonest ids first; ids have 2^16ths of their group.
        some = np.flatnonzero(self.freq)
        some = some[np.argsort(-self.freq[some], kind="stable")]
        mass = self.freq[some]
        group = np.minimum((np.cumsum(mass) - mass) * GROUPS >> 16, GROUPS - 1)
        self.group = np.zeros(VOCAB, np.int64)
        self.group[some] = group
        self.cum, self.share = np.zeros(VOCAB, np.int64), np.zeros(VOCAB, np.int64)
        self.slot = np.zeros((GROUPS, 1 << 16), np.uint16)
        edges = np.zeros(GROUPS + 1, np.int64)
        for g in range(GROUPS):
            own = some[group == g]
            if len(own):
                share = np.maximum(1, self.freq[own] * (65536 - len(own)) // self.freq[own].sum())
                share[0] += 65536 - share.sum()
                self.share[own], self.cum[own] = share, np.cumsum(share) - share
                self.slot[g] = np.repeat(own, share)
            edges[g + 1] = edges[g] + self.freq[own].sum()
        self.slot = self.slot.ravel()
        # Groups start from the prior's shares, each FLOOR at least.
        self.edges = (edges * (65536 - GROUPS * FLOOR) >> 16) + _EDGE * FLOOR
        self.edges[-1] = 65536
        self.stretch = STRETCH[np.minimum(self.freq >> 4, 4095)]

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        n = np.zeros(VOCAB, np.int64)
        for at in range(0, len(ids), 1 << 18):  # bincount makes 8 bytes of an id
            n += np.bincount(ids[at : at + (1 << 18)], minlength=VOCAB)
        some = np.flatnonzero(n)
        freq = np.zeros(VOCAB, np.int64)
        freq[some] = np.maximum(1, n[some] * (65536 - len(some)) // n.sum())
        freq[some[np.argmax(n[some])]] += 65536 - freq.sum()
        return cls(freq, _commonest(ids, 1, T1), _commonest(ids, 2, T2))

    def pack(self) -> bytes:
        some = np.flatnonzero(self.freq)
        raw = struct.pack("<I", len(some)) + np.diff(some, prepend=0).astype("<u2").tobytes() + (self.freq[some] - 1).astype("<u2").tobytes()
        for first in (self.first1, self.first2):
            raw += (first & 0xFFFF).astype("<u2").tobytes() + (first >> 16).astype("u1").tobytes()
        return zlib.compress(raw, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        some = np.cumsum(np.frombuffer(raw, "<u2", n, 4).astype(np.int64))
        freq = np.zeros(VOCAB, np.int64)
        freq[some] = np.frombuffer(raw, "<u2", n, 4 + 2 * n).astype(np.int64) + 1
        at, firsts = 4 + 4 * n, []
        for slots in (T1, T2):
            firsts.append(np.frombuffer(raw, "<u2", slots, at).astype(np.int32) | np.frombuffer(raw, "u1", slots, at + 2 * slots).astype(np.int32) << 16)
            at += 3 * slots
        return cls(freq, *firsts)


class Model:
    """The adaptive state of all lanes; ``lanes`` are blocks in step. Arrays of two rows are of order 1 and order 2."""

    def __init__(self, lanes: int, prior: Prior):
        # A slot holds id << 12 | check << 4 | confidence.
        first = lambda x: (x & 0xFFFF) << 12 | (x >> 16) << 4 | 1
        self.prior = prior
        self.slots = np.concatenate([np.tile(first(x.astype(np.int32)), lanes) for x in (prior.first1, prior.first2)])
        self.belief = np.tile(np.minimum(1024 + 3072 * np.arange(16), MOST).astype(np.int32), 2 * lanes)
        self.groups = np.tile(prior.edges.astype(np.int32) << FINE, (lanes, 1))
        # Weights of 2^16: of order 2, 1, 0 for the first candidate (by whether order 1 names it too), of order 1, 0 for the second.
        self.mix = np.concatenate([np.tile(np.array(w, np.int32), lanes) for w in ([60000, 60000], [6000, 30000], [6000, 6000])])
        self.mix_b = np.repeat(np.array([[60000], [6000]], np.int32), lanes, 1)
        lane = np.arange(lanes, dtype=np.int64)
        self.at_slot = np.stack([lane * T1, lanes * T1 + lane * T2])
        self.at_belief = np.stack([lane * 16, lanes * 16 + lane * 16])
        self.at_mix = np.stack([lane * 2 + 2 * lanes * k for k in range(3)])
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self, m: int) -> tuple[np.ndarray, ...]:
        """For the first m lanes: the two ids, and the ends of their intervals of 2^16."""
        h = self.p1[:m] * 40503
        k = h + self.p2[:m] * 60493
        self.i, self.c = np.empty((2, m), np.int64), np.empty((2, m), np.int32)
        self.i[0], self.i[1] = h >> 4 & (T1 - 1), k >> 5 & (T2 - 1)
        self.c[0], self.c[1] = h >> 10 & 0xFF0, k >> 12 & 0xFF0
        self.i += self.at_slot[:, :m]
        self.e = e = self.slots.take(self.i)
        self.ok, self.sure = e & 0xFF0 == self.c, e & 15
        self.j = self.at_belief[:, :m] + self.sure * self.ok
        self.y = y = e >> 12
        self.v = self.belief.take(self.j)
        s = STRETCH.take(self.v >> 4)
        self.in_b = self.prior.stretch.take(y)
        self.same = y[0] == y[1]
        self.k = self.at_mix[:, :m] + self.same
        self.in_a = np.empty((3, m), np.int32)
        self.in_a[0], self.in_a[2] = s[1], self.in_b[1]
        np.multiply(s[0], SIGN.take(self.same), out=self.in_a[1])
        self.in_b[1] = self.in_b[0]
        self.in_b[0] = s[0]
        self.wa = self.mix.take(self.k)
        x = self.wa * self.in_a
        self.pa = SQUASH.take((x[0] + x[1] + x[2] >> 16) + 2047, mode="clip")
        x = self.mix_b[:, :m] * self.in_b
        self.pb = SQUASH.take((x[0] + x[1] >> 16) + 2047, mode="clip")
        end2 = self.pa.astype(np.int64)
        return y[0], y[1], end2, end2 + ((65536 - end2) * self.pb >> 16) * ~self.same

    def update(self, m: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int32)
        hit = self.y == ids
        some = self.c | 1
        some |= ids << 12
        new = np.where(self.sure > 1, self.e - 1, some)  # a miss: less confidence, or the id that came
        surer = RAISE.take(self.sure) * self.ok
        surer += self.e & ~0xFF0
        surer += self.c
        self.slots[self.i] = np.where(hit, surer, new)
        x = HIT.take(hit.view(np.uint8))
        x -= self.v
        x >>= 5
        x += self.v
        self.belief[self.j] = x
        # Weights follow the gradient of the coding cost: the error times the input.
        hit = hit.astype(np.int32)
        hit <<= 16
        x = self.in_a * (hit[1] - self.pa >> 4)
        x >>= 11
        x += self.wa
        self.mix[self.k] = x.clip(-MOST_WEIGHT, MOST_WEIGHT, out=x)
        x = self.in_b * ((hit[0] - self.pb >> 4) * ((hit[1] == 0) & ~self.same))
        x >>= 11
        x += self.mix_b[:, :m]
        x.clip(-MOST_WEIGHT, MOST_WEIGHT, out=self.mix_b[:, :m])
        self.p2[:m] = self.p1[:m]
        self.p1[:m] = ids

    def find(self, lanes: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The last group of order 0 of these lanes that begins at ``upto`` or before."""
        edges, at = self.groups.ravel(), lanes * (GROUPS + 1)
        first, step = at, GROUPS // 2
        while step:
            at = at + step * (edges.take(at + step) <= upto)
            step //= 2
        return at - first

    def learn(self, lanes: np.ndarray, group: np.ndarray) -> None:
        """Order 0 of these lanes moves to the group that came."""
        edges = self.groups.take(lanes, 0)
        x = MIXIN.take(group, 0)
        x -= edges
        x >>= RATE
        x += edges
        self.groups[lanes] = x


def block_size(n: int) -> int:
    """The block size for a sequence of n ids."""
    block = LEAST
    while block < BLOCK and n > block * LANES:
        block *= 2
    return block


def _live(n: int, lanes: int, block: int, k: int) -> int:
    """Lanes that have an id at step k; only the last block may be short."""
    return lanes if k < n - (lanes - 1) * block else lanes - 1


class _Writer:
    def __init__(self, lanes: int, words: int):
        """``words`` is what a lane has room for at first."""
        self.low, self.rng = np.zeros(lanes, U), np.full(lanes, 1 << 56, U)
        self.out, self.pos = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)
        self.upto = 0  # no lane is beyond this

    def _room(self) -> None:
        """Makes lanes longer once one of them is nearly full."""
        self.upto = int(self.pos.max())
        lanes, words = self.out.shape
        if self.upto + 64 > words:
            out = np.zeros((lanes, words + max(words // 2, 128)), np.uint16)
            out[:, :words] = self.out
            self.out = out

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        """Codes intervals of 2^24 on some lanes, or on the first ones; a lane puts out two words at most."""
        self.upto += 2
        if self.upto + 8 > self.out.shape[1]:
            self._room()
        old = self.low[lanes]
        r = self.rng[lanes] >> U(24)
        new = old + r * start.view(U)
        over = np.flatnonzero(new < old)
        if len(over):
            self._carry(over if isinstance(lanes, slice) else lanes[over])
        rng = r * size.view(U)
        self.low[lanes], self.rng[lanes] = new, rng
        on = np.flatnonzero(rng < LOW40)
        on = on if isinstance(lanes, slice) else lanes[on]
        while len(on):
            lo = self.low[on]
            self.out[on, self.pos[on]] = lo >> U(48)
            self.pos[on] += 1
            self.low[on] = lo << U(16)
            ra = self.rng[on] << U(16)
            self.rng[on] = ra
            on = on[ra < LOW40]

    def _carry(self, lanes: np.ndarray) -> None:
        """Adds one to what these lanes have put out."""
        at = self.pos[lanes] - 1
        while len(lanes):
            self.out[lanes, at] += 1
            on = self.out[lanes, at] == 0
            lanes, at = lanes[on], at[on] - 1

    def blocks(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.out[every, self.pos] = self.low >> U(48)
            self.low <<= U(16)
            self.pos += 1
        return [self.out[i, : self.pos[i]].astype("<u2").tobytes() for i in every]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        self.words = np.frombuffer(b"".join([*blocks, bytes(16)]), "<u2")
        self.pos = np.concatenate([[0], np.cumsum([len(b) // 2 for b in blocks])[:-1]])
        # The decoder needs the code less low only.
        self.rng, self.code = np.full(len(blocks), 1 << 56, U), np.zeros(len(blocks), U)
        for _ in range(4):
            self.code = self.code << U(16) | self.words[self.pos]
            self.pos += 1

    def peek(self, lanes: np.ndarray | slice) -> np.ndarray:
        """Where in 2^24 the code is."""
        self.r = self.rng[lanes] >> U(24)
        return np.minimum(self.code[lanes] // self.r, U(0xFFFFFF)).view(np.int64)

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        """Leaves the intervals that were peeked at."""
        self.code[lanes] -= self.r * start.view(U)
        rng = self.r * size.view(U)
        self.rng[lanes] = rng
        on = np.flatnonzero(rng < LOW40)
        on = on if isinstance(lanes, slice) else lanes[on]
        while len(on):
            self.code[on] = self.code[on] << U(16) | self.words[self.pos[on]]
            self.pos[on] += 1
            ra = self.rng[on] << U(16)
            self.rng[on] = ra
            on = on[ra < LOW40]


def encode(ids: np.ndarray, prior: Prior, block: int) -> list[bytes]:
    """The coded blocks of a sequence of ids that the prior knows."""
    n = len(ids)
    lanes = -(-n // block)
    grid, full = np.zeros((block, lanes), np.uint16), n // block
    grid[:, :full] = ids[: full * block].reshape(full, block).T
    grid[: n - full * block, full:] = ids[full * block :, None]
    model, writer = Model(lanes, prior), _Writer(lanes, block // 2 + 128)
    edges = model.groups.ravel()
    for k in range(min(n, block)):
        m = _live(n, lanes, block, k)
        x = grid[k, :m].astype(np.int32)
        y1, y2, end2, end1 = model.predict(m)
        is2 = x == y2
        is1 = (x == y1) & ~is2
        start, size = end2 * is1 << 8, np.where(is2, end2, end1 - end2) << 8
        on = np.flatnonzero(~(is1 | is2))
        gone = x[on]
        group = prior.group.take(gone)
        end, edge = end1[on], on * (GROUPS + 1) + group
        rest = 65536 - end
        low = rest * edges.take(edge) >> FINE + 8
        start[on] = low + (end << 8)
        size[on] = (rest * edges.take(edge + 1) >> FINE + 8) - low
        writer.put(slice(0, m), start, size)
        if len(on):
            writer.put(on, prior.cum.take(gone) << 8, prior.share.take(gone) << 8)
            model.learn(on, group)
        model.update(m, x)
    return writer.blocks()


def decode(blocks: list[bytes], n: int, prior: Prior, block: int) -> np.ndarray:
    """The n ids of coded blocks, in their order; all blocks but the last hold ``block`` ids."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.uint16)
    model, reader = Model(lanes, prior), _Reader(blocks)
    grid = np.zeros((block, lanes), np.uint16)
    edges = model.groups.ravel()
    for k in range(min(n, block)):
        m = _live(n, lanes, block, k)
        y1, y2, end2, end1 = model.predict(m)
        v = reader.peek(slice(0, m))
        is2 = v < end2 << 8
        is1 = (v < end1 << 8) & ~is2
        x = np.where(is2, y2, y1)
        start, size = end2 * is1 << 8, np.where(is2, end2, end1 - end2) << 8
        on = np.flatnonzero(~(is1 | is2))
        end = end1[on]
        rest, edge = 65536 - end, end << 8
        upto = ((v[on] - edge + 1 << FINE + 8) - 1) // rest  # the greatest edge that isn't above
        group = model.find(on, upto)
        at = on * (GROUPS + 1) + group
        low = rest * edges.take(at) >> FINE + 8
        start[on] = low + edge
        size[on] = (rest * edges.take(at + 1) >> FINE + 8) - low
        reader.take(slice(0, m), start, size)
        if len(on):
            w = reader.peek(on)
            came = prior.slot.take(group << 16 | w >> 8)
            x[on] = came
            reader.take(on, prior.cum.take(came) << 8, prior.share.take(came) << 8)
            model.learn(on, group)
        grid[k, :m] = x
        model.update(m, x)
    return np.ascontiguousarray(grid.T).ravel()[:n]
