"""Language-model scoring by logistic context mixing over the bits of a text.

A text is its bytes with A-Z lower-cased and one zero byte as its end, cut into
segments: a word with the blank behind it. Each bit of a segment is predicted from
hashed contexts: its last 1, 2, 3, 4 and 6 bytes and all of it so far, each with the
known bits of the current byte. A context's slot holds how often a 0 and a 1
followed in all training texts; a learned map turns such a pair of counts into a
probability. The predictions are mixed in the logistic domain by a weight vector
that a gate selects (how much evidence the two longest contexts have, and the bit's
place), and an adaptive map from (known bits, prediction) to probabilities refines
the mix. Over whole segments a last predictor names the segment that followed the
same two segments before; its weight against the mixed bits is learned for each
count and each run of hits.

Everything is gathered over every byte of every training text, in four passes:
1. The texts give the exact vocabulary (each distinct segment with its count, a table
   that grows with the corpus) and votes for the segment after two segments.
2. The vocabulary, sorted so that equal beginnings stand together and are worked on once,
   gives the bit counts, a task a context, and the exact word counts. A slot's pair of
   counts becomes a code of 16 bits (exact while small, then the ratio). The map of
   count pairs follows from the counts alone: a slot with n0 zeros and n1
   ones saw n0 times a 0 beside (n0 - 1, n1) and n1 times a 1 beside (n0, n1 - 1).
3. Weights, gates and the adaptive map are learned online over the whole vocabulary, once, a
   segment weighing as often as it occurs, each with one own occurrence taken out of
   the counts. Tasks learn the segments whose beginnings have their hash; their weights
   are averaged by the evidence each gate had.
4. The texts give how often the named segment was right.
Tables are then frozen, so a score does not depend on the order or the partition in
which texts are read. The HEAD_SEGMENTS most frequent segments are scored once, all
others where they occur.

Tables of counts have as many slots as the vocabulary needs, at most SIZES and PAIRS
(contexts share slots beyond that), so what is broadcast is bounded: 40 MB of codes, 40
MB of named segments, 6 MB of scored ones. Word counts for the base score are exact: the
HEAD_WORDS most frequent words are broadcast (4 MB), all other words are joined.

Defined results: null is the empty text (one token, the end); a null id is in
training; repeated rows are scored each; with no training rows N = V = 0 and the bit
model knows nothing; further columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import drop_saved, ready, saved, tidied
from .textnp import LOWER, NOT_BLANK, U, _BYTE, _powers, mix, slices, word_hashes, words

ORDERS = (1, 2, 3, 4, 6)
#: log2 of the slots of each context, the whole segment last, and of the table of pairs, at most
SIZES = (16, 18, 20, 21, 23, 23)
PAIRS = 22
CONTEXTS = len(SIZES)
CHUNK = 1 << 16
#: slots of a piece of the table of pairs (40 KB, so that pages of the tables written stay small)
PAIR_CHUNK = 1 << 12
HEAD_WORDS = 250_000
#: distinct segments a task gathers before it hands their counts on
FLUSH_SEGMENTS = 1 << 18
#: segments scored once for all tasks, and others that a task keeps
HEAD_SEGMENTS = 500_000
KEPT_SEGMENTS = 1 << 17
BATCH_BYTES = 1 << 20
#: bytes of the vocabulary worked on at once, about a hundred times as many in arrays
BLOCK_BYTES = 1 << 17
#: a task gathers pairs of about so many bytes of text, as its table is as large for few
PART_BYTES = 64 << 20
#: bytes of the vocabulary that a task counts, and that a task learns
COUNT_BYTES, LEARN_BYTES = 64 << 20, 8 << 20
MIN_PARTS = 6
#: rows that a reader of saved tables decodes at once
READ_ROWS = 256
_READ = "spark.sql.parquet.columnarReaderBatchSize"
RATE = 0.02
#: byte positions of a learning step, at first and later
STEPS = (512, 8192)
_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each row's end, starts and ends of segments, and each row's first segment."""
    n = len(offs) - 1
    buf = np.insert(LOWER[data], offs[1:], 0)
    ends = offs[1:] + np.arange(n)
    close = ~NOT_BLANK[buf]
    close[ends] = True
    e = np.flatnonzero(close) + 1
    s = np.append(0, e[:-1])
    return buf, s, e, np.append(0, np.searchsorted(e, ends + 1) + 1)


def spelled(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte of the given segments: it with the seven before it, its place, the hash of all before it; and bounds."""
    size = e - s
    bounds = np.append(0, np.cumsum(size))
    j = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    cur = buf[np.repeat(s, size) + j]
    w = cur.astype(U)
    out = w.copy()
    for k in range(1, 8):
        out[k:] |= w[:-k] << U(8 * k)
    near = np.flatnonzero(j < 7)
    out[near] &= (U(1) << (U(8) * (j[near] + 1).astype(U))) - U(1)
    p, inv = _powers(len(cur) + 1)
    c = np.zeros(len(cur) + 1, U)
    np.cumsum(_BYTE[cur] * p[: len(cur)], out=c[1:])
    first = np.repeat(bounds[:-1], size)
    return out, j, mix((c[:-1] - c[first]) * inv[first] + j.astype(U) * U(0xC2B2AE3D27D4EB4F)), bounds


def context_hash(i: int, w: np.ndarray, j: np.ndarray, ph: np.ndarray) -> np.ndarray:
    """The hash of context i at each position."""
    if i == len(ORDERS):
        return ph
    k = ORDERS[i]
    return mix(((w >> U(8)) & U((1 << (8 * k)) - 1)) * U(64) + np.minimum(j, k).astype(U) * U(8) + U(k))


def table_sizes(vocabulary_bytes: int, most: tuple[int, ...] = SIZES) -> list[int]:
    """log2 of the slots of each context: two for each byte of the vocabulary, between 2 ** 10 and the bound."""
    need = max(10, int(np.ceil(np.log2(2 * vocabulary_bytes + 1))))
    return [min(t, need) for t in most]


def _slots(h: np.ndarray, node: np.ndarray, t: int) -> np.ndarray:
    return (((h ^ (node * _K1)) * _K2) >> U(64 - t)).astype(np.int64)


def count_bits(i: int, w: np.ndarray, j: np.ndarray, ph: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
    """Add byte positions, each n times, to context i's sums[bit, slot]."""
    size = int(sums.shape[1]).bit_length() - 1
    h, node = context_hash(i, w, j, ph), np.ones(len(w), U)
    flat = sums.reshape(-1)
    for place in range(7, -1, -1):
        bit = (w >> U(place)) & U(1)
        np.add.at(flat, _slots(h, node, size) + (bit.astype(np.int64) << size), n)
        node = node * U(2) + bit


def pair_keys(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments with two before them in their row, slot, value) in the table of pairs: 24 bits of the two, 40 of the segment."""
    i = np.arange(len(h))
    ok = np.flatnonzero(i - np.repeat(first[:-1], np.diff(first)) >= 2)
    key = mix(h[ok - 1] * _K1 + mix(h[ok - 2]))
    return ok, (key >> U(64 - size)).astype(np.int64), (key & U(0xFFFFFF)) << U(40) | (h[ok] >> U(24))


def same_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether values stand for the same two segments before."""
    return (a ^ b) >> U(40) == 0


def merge_pairs(val: np.ndarray, cnt: np.ndarray, slot: np.ndarray, v: np.ndarray, n: np.ndarray) -> None:
    """Majority votes: equal values add up, others wear each other down; slots must be distinct."""
    same = val[slot] == v
    old = cnt[slot].astype(np.int64)
    now = np.where(same, old + n, np.abs(old - n))
    win = same | (n > old)
    val[slot[win]] = v[win]
    cnt[slot] = np.minimum(now, 60_000)


def vote_pairs(val: np.ndarray, cnt: np.ndarray, slot: np.ndarray, v: np.ndarray, last: np.ndarray) -> None:
    """Of several values for one slot the most frequent one votes; last is room for a number a slot."""
    if not len(slot):
        return
    _, at, n = np.unique(mix(v + slot.astype(U) * _K1), return_index=True, return_counts=True)
    order = np.argsort(np.minimum(n, 30_000).astype(np.int16), kind="stable")
    slot, v, n = slot[at[order]], v[at[order]], n[order]
    i = np.arange(len(slot), dtype=np.int32)
    # the greatest number stays, as later ones are written over earlier ones
    last[slot] = i
    pick = last[slot] == i
    merge_pairs(val, cnt, slot[pick], v[pick], n[pick])


# counts of a 0 or a 1 in ten classes
_CLASS = np.array([1, 2, 3, 4, 6, 10, 20, 50, 200])
_MID = np.array([0, 1, 2, 3, 4.5, 7, 14, 32, 100, 400])
LEVELS = 24


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


_CLASS_OF = np.searchsorted(_CLASS, np.arange(int(_CLASS[-1]) + 1), "right")


def _state(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    top = _CLASS[-1]
    return _CLASS_OF[np.minimum(n0, top)] * 10 + _CLASS_OF[np.minimum(n1, top)]


# codes of pairs of counts: (0, n) up to 255, (n, 0) up to 255, both up to 63 in all, then the stretched ratio
_SIDE, _BOTH, _FINE, _WIDEST = 256, 64, 200, 9
_RATIO = 2 * _SIDE + _BOTH * _BOTH
CODES = _RATIO + 2 * _WIDEST * _FINE + 1
_N0 = np.concatenate([np.zeros(_SIDE, np.int64), np.arange(_SIDE), np.repeat(np.arange(_BOTH), _BOTH)])
_N1 = np.concatenate([np.arange(_SIDE), np.zeros(_SIDE, np.int64), np.tile(np.arange(_BOTH), _BOTH)])


def _ratio(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(_stretch((n1 + 0.2) / (n0 + n1 + 0.4)), -_WIDEST, _WIDEST)


def codes(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The code of each pair of counts."""
    out = np.where(n0 == 0, np.minimum(n1, _SIDE - 1), _SIDE + np.minimum(n0, _SIDE - 1))
    two = (n0 > 0) & (n1 > 0)
    small = two & (n0 + n1 < _BOTH)
    out[small] = 2 * _SIDE + n0[small] * _BOTH + n1[small]
    large = two & ~small
    out[large] = _RATIO + np.round((_ratio(n0[large], n1[large]) + _WIDEST) * _FINE).astype(np.int64)
    return out.astype(np.uint16)


def tiers(seen: np.ndarray, whole: bool) -> np.ndarray:
    """Classes of evidence: five of the whole segment, three of the context before it."""
    return np.searchsorted([1, 2, 5, 31] if whole else [1, 2], seen, "right").astype(np.uint8)


GATES = 15 * 8


GATES = 15 * 8
#: steps of the grid of mixed predictions that scoring reads
_GRID, _REACH = 64, 12


class Model:
    """What is learned: maps of count pairs, gated weights, the adaptive map, trust in named segments."""

    def __init__(self) -> None:
        r0, r1 = np.repeat(_MID, 10), np.tile(_MID, 10)
        self.states = np.tile(_stretch((r1 + 0.2) / (r0 + r1 + 0.4)), (CONTEXTS, 1))
        self.seen = np.zeros((CONTEXTS, 100, 2))
        self.w = np.full((GATES, CONTEXTS), 0.25)
        self.map = np.tile(_squash((np.arange(LEVELS + 1) - LEVELS / 2) / 1.5), (256, 1))
        self.trust = np.tile(np.array([0.01, 0.3, 0.6, 0.8])[:, None], (1, 4))
        #: evidence of each gate, and of each point of the map
        self.gate_n, self.map_n = np.zeros(GATES), np.zeros(256 * (LEVELS + 1))
        #: how often each gate was stepped, and running squares of its gradients
        self.steps, self.square = np.zeros(GATES), np.zeros((GATES, CONTEXTS))

    def stretched(self, k: int, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """The prediction of context k for pairs of counts, in the logistic domain."""
        plain = (np.minimum(n0, n1) > 0) & (n0 + n1 >= 20)
        return np.clip(np.where(plain, _ratio(n0, n1), self.states[k][_state(n0, n1)]), -_WIDEST, _WIDEST)

    def of_codes(self, k: int, bit: int | None = None) -> np.ndarray:
        """The prediction of context k for every code, without one own occurrence of bit."""
        n0, n1 = np.maximum(_N0 - (bit == 0), 0), np.maximum(_N1 - (bit == 1), 0)
        return np.concatenate([self.stretched(k, n0, n1), np.arange(CODES - _RATIO) / _FINE - _WIDEST]).astype(np.float32)

    def refined(self, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pos = np.clip(x * 1.5 + LEVELS / 2, 0, LEVELS - 1e-6)
        lo = pos.astype(np.int64)
        f = pos - lo
        q = self.map[node, lo] * (1 - f) + self.map[node, lo + 1] * f
        return np.clip(0.5 * (_squash(x) + q), 1 / 65536, 1 - 1 / 65536), lo, f

    def see_counts(self, k: int, sums: np.ndarray) -> None:
        """Count which bit stood beside which pair of counts without it, over all occurrences in some slots of context k."""
        n0, n1 = sums[:, sums.any(0)]
        some0, some1 = n0 > 0, n1 > 0
        self.seen[k, :, 0] += np.bincount(_state(n0[some0] - 1, n1[some0]), n0[some0], 100)
        self.seen[k, :, 1] += np.bincount(_state(n0[some1], n1[some1] - 1), n1[some1], 100)

    def learn_states(self) -> None:
        turned = self.seen.reshape(CONTEXTS, 10, 10, 2).transpose(0, 2, 1, 3)[..., ::-1].reshape(CONTEXTS, 100, 2)
        both = self.seen + turned  # a map that treats 0 and 1 alike
        self.states = _stretch(np.clip((both[..., 1] + 2 * _squash(self.states)) / (both.sum(2) + 2), 1e-5, 1 - 1e-5))

    def learn(self, w: np.ndarray, j: np.ndarray, ph: np.ndarray, n: np.ndarray, tables: list[np.ndarray], rate: float) -> None:
        """One online step over byte positions that occur n times each."""
        n = n.astype(np.float64)
        own = [np.concatenate([self.of_codes(k, b) for b in (0, 1)]) for k in range(CONTEXTS)]
        gates = _gates_of_codes(True)
        m = len(self.map_n)
        for i, bit, node, code in _walk(w, j, ph, tables):
            code = [c + bit.astype(np.int32) * CODES for c in code]
            st = np.stack([t[c] for t, c in zip(own, code, strict=True)], 1)
            gate = (gates[0][code[-1]] + gates[1][code[-2]]) * 8 + i
            x = np.einsum("ij,ij->i", st, self.w.astype(np.float32)[gate]).astype(np.float64)
            err = n * (bit - _squash(x))
            size = np.bincount(gate, n, GATES)
            g = np.stack([np.bincount(gate, err * st[:, k], GATES) for k in range(CONTEXTS)], 1) / np.maximum(size, 1e-9)[:, None]
            some = size > 0
            # steps of the size of rate, whatever the gradient's scale: frequent segments are well predicted and have small ones
            self.steps += some
            self.square[some] = 0.95 * self.square[some] + 0.05 * g[some] ** 2
            now = 1 - 0.95 ** self.steps[some]
            self.w[some] += rate * g[some] / (np.sqrt(self.square[some] / now[:, None]) + 1e-8)
            self.gate_n += size
            pos = np.clip(x * 1.5 + LEVELS / 2, 0, LEVELS - 1e-6)
            lo = pos.astype(np.int64)
            share = pos - lo
            at = node * (LEVELS + 1) + lo
            low, high = (1 - share) * n, share * n
            much = np.bincount(at, low, m) + np.bincount(at + 1, high, m)
            ones = np.bincount(at, low * bit, m) + np.bincount(at + 1, high * bit, m)
            often = np.bincount(at, 1 - share, m) + np.bincount(at + 1, share, m)
            flat = self.map.reshape(-1)
            hit = much > 0
            flat[hit] += (1 - 0.98 ** often[hit]) * (ones[hit] / much[hit] - flat[hit])
            np.clip(flat, 1e-5, 1 - 1e-5, out=flat)
            self.map_n += much

    def merge(self, parts: list["Model"]) -> None:
        """The mean of parts' weights and maps, by the evidence each gate and point had; without any it stays."""
        gate, point = sum(p.gate_n for p in parts), sum(p.map_n for p in parts)
        if parts:
            w = sum(p.w * p.gate_n[:, None] for p in parts)
            self.w = np.where(gate[:, None] > 0, w / np.maximum(gate, 1e-9)[:, None], self.w)
            m = sum(p.map.reshape(-1) * p.map_n for p in parts)
            self.map = np.where(point > 0, m / np.maximum(point, 1e-9), self.map.reshape(-1)).reshape(self.map.shape)

    def grid(self) -> np.ndarray:
        """The refined probability of a 1 for known bits (rows) and mixed predictions in steps of 1 / _GRID."""
        x = np.arange(-_REACH * _GRID, _REACH * _GRID + 1) / _GRID
        return np.stack([self.refined(x, np.full(len(x), node))[0] for node in range(256)])


def _gates_of_codes(own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Classes of evidence of each code for the whole segment (times three) and the context before it, without an own occurrence."""
    seen = np.concatenate([_N0 + _N1, np.full(CODES - _RATIO, _BOTH)])
    seen = np.maximum(seen - own, 0)
    whole, before = tiers(seen, True).astype(np.int64) * 3, tiers(seen, False).astype(np.int64)
    return (np.tile(whole, 2), np.tile(before, 2)) if own else (whole, before)


def _walk(w: np.ndarray, j: np.ndarray, ph: np.ndarray, tables: list[np.ndarray]) -> Iterator[tuple]:
    """Bit by bit: (place, bit, known bits, codes of each context)."""
    hs = [context_hash(k, w, j, ph) for k in range(CONTEXTS)]
    node = np.ones(len(w), U)
    for i in range(7, -1, -1):
        bit = (w >> U(i)) & U(1)
        yield i, bit.astype(np.int64), node.astype(np.int64), [t[_slots(h, node, len(t).bit_length() - 1)].astype(np.int32) for h, t in zip(hs, tables, strict=True)]
        node = node * U(2) + bit


def alike(w: np.ndarray, ph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of positions with the same beginning and byte one, and which of those each is."""
    _, at, inv = np.unique(mix(ph + (w & U(0xFF)) * _K1), return_index=True, return_inverse=True)
    return at, inv


def runs_of_hits(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the segments just before, in the same row, were named rightly: 0, 1, 2 or more than 2."""
    out = np.zeros(len(hit), np.int64)
    begin = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(hit))
    live = np.ones(len(hit), bool)
    for k in range(1, 4):
        live &= (at - k >= begin) & hit[np.maximum(at - k, 0)]
        out += live
    return out


class Scorer:
    """Frozen tables; log2 probabilities of the head's segments, and of others seen before, are kept."""

    def __init__(self, tables: list[np.ndarray], val: np.ndarray, cnt: np.ndarray, model: Model, head: tuple[np.ndarray, np.ndarray] | None = None):
        self.tables, self.val, self.cnt, self.model = tables, val, cnt, model
        self.codes = [model.of_codes(k) for k in range(CONTEXTS)]
        self.gates, self.grid = _gates_of_codes(False), model.grid().reshape(-1)
        self.w = (model.w * _GRID).astype(np.float32)
        self.head = head or (np.zeros(0, U), np.zeros(0, np.float32))
        self.rest = (np.zeros(0, U), np.zeros(0))

    def fresh(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Mixed log2 probabilities of segments, computed."""
        w, j, ph, bounds = spelled(buf, s, e)
        at, inv = alike(w, ph)
        out = np.ones(len(at))
        wide = 2 * _REACH * _GRID + 1
        for a in range(0, len(at), 1 << 14):
            some = at[a : a + (1 << 14)]
            p = out[a : a + (1 << 14)]
            for i, bit, node, code in _walk(w[some], j[some], ph[some], self.tables):
                st = np.stack([t[c] for t, c in zip(self.codes, code, strict=True)], 1)
                gate = (self.gates[0][code[-1]] + self.gates[1][code[-2]]) * 8 + i
                x = np.einsum("ij,ij->i", st, self.w[gate])
                q = self.grid[node * wide + np.clip(np.rint(x).astype(np.int64) + _REACH * _GRID, 0, wide - 1)]
                p *= np.where(bit == 1, q, 1 - q)
        return np.add.reduceat(np.log2(out)[inv], bounds[:-1])

    def bits(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Mixed log2 probabilities of segments."""
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        val = np.empty(len(uniq))
        new = np.arange(len(uniq))
        for known, value in (self.head, self.rest):
            if len(known):
                i = np.searchsorted(known, uniq[new])
                i[i == len(known)] = 0
                have = known[i] == uniq[new]
                val[new[have]] = value[i[have]]
                new = new[~have]
        if len(new):
            size = np.cumsum(e[at[new]] - s[at[new]])
            for some in np.split(new, np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1):
                val[some] = self.fresh(buf, s[at[some]], e[at[some]])
            known, value = self.rest
            if len(known) + len(new) > KEPT_SEGMENTS:
                self.rest = (uniq[new], val[new])
            else:
                both = np.concatenate([known, uniq[new]])
                order = np.argsort(both, kind="stable")
                self.rest = (both[order], np.concatenate([value, val[new]])[order])
        return val[inv]

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability and bytes (with the end) of each row."""
        buf, s, e, first = segments(data, offs)
        h = word_hashes(buf, s, e)
        bits = self.bits(buf, s, e, h)
        ok, slot, v = pair_keys(h, first, len(self.cnt).bit_length() - 1)
        n = self.cnt[slot].astype(np.int64)
        named = (n > 0) & same_pair(self.val[slot], v)
        hit = np.zeros(len(h), bool)
        hit[ok] = named & (self.val[slot] == v)
        p = self.model.trust[runs_of_hits(hit, first)[ok], np.searchsorted([2, 3, 8], n, "right")]
        some = ok[named]
        p = p[named]
        bits[some] = np.log2(p * hit[some] + (1 - p) * np.exp2(np.maximum(bits[some], -1000)))
        return np.add.reduceat(bits, first[:-1]), offs[1:] - offs[:-1] + 1


def see_named(val: np.ndarray, cnt: np.ndarray, data: np.ndarray, offs: np.ndarray, seen: np.ndarray) -> None:
    """Add to seen[run of hits, class of count, right] how often named segments are right, counts without the own occurrence."""
    buf, s, e, first = segments(data, offs)
    h = word_hashes(buf, s, e)
    ok, slot, v = pair_keys(h, first, len(cnt).bit_length() - 1)
    right = val[slot] == v
    n = cnt[slot].astype(np.int64) - right
    named = (n > 0) & same_pair(val[slot], v)
    hit = np.zeros(len(h), bool)
    hit[ok] = named & right
    run = runs_of_hits(hit, first)[ok]
    np.add.at(seen, (run[named], np.searchsorted([2, 3, 8], n[named], "right"), right[named].astype(int)), 1)


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hash, count, size, bytes) of parts of the same form, equal hashes added up."""
    h, n, size, buf = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    at = order[first]
    begin = np.cumsum(size) - size
    return h[at], np.add.reduceat(n[order], first), size[at], _bytes_of(buf, begin[at], size[at])


def _bytes_of(buf: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    return buf[np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _part() -> int:
    """The number of the running task's partition, 0 outside of tasks."""
    from pyspark import TaskContext

    here = TaskContext.get()
    return here.partitionId() if here else 0


_GATHERED = "kind int, h long, n long, body binary"


def _row(kind: int, part: int, n: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([body], pa.binary())], ["kind", "h", "n", "body"])


@tidied
def _gather(pair_bits: int, flush: int = FLUSH_SEGMENTS) -> object:
    """Rows of kind -2: segments with their counts; -1: the number of texts; 0 and more: pieces of the table of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _part()
        val, cnt, last = np.zeros(1 << pair_bits, U), np.zeros(1 << pair_bits, np.uint16), np.zeros(1 << pair_bits, np.int32)
        wait: list[tuple[np.ndarray, ...]] = []
        held, texts = 0, 0

        def segments_out() -> Iterator[pa.RecordBatch]:
            h, n, size, buf = wait[0] if len(wait) == 1 else _distinct(wait)
            ends = np.cumsum(size)
            for some in np.split(np.arange(len(h)), np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1):
                if len(some):
                    a, b = some[0], some[-1] + 1
                    lo = int(ends[a] - size[a])
                    bounds = np.append(0, ends[a:b] - lo).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[lo : ends[b - 1]]))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, -2, np.int32)), pa.array(h[a:b].view(np.int64)), pa.array(n[a:b]), body], ["kind", "h", "n", "body"])

        for batch in batches:
            for a, b, data, offs in slices(batch.column(0), BATCH_BYTES):
                texts += b - a
                buf, s, e, first = segments(data, offs)
                h = word_hashes(buf, s, e)
                _, slot, v = pair_keys(h, first, pair_bits)
                vote_pairs(val, cnt, slot, v, last)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                size = e[at] - s[at]
                wait.append((u, c.astype(np.int64), size, _bytes_of(buf, s[at], size)))
                held += len(u)
                if held > flush or len(wait) >= 64:
                    wait[:] = [_distinct(wait)]
                    held = len(wait[0][0])
                    if held > flush // 2:
                        yield from segments_out()
                        wait, held = [], 0
        if wait:
            yield from segments_out()
        if texts:
            for c in range(0, max(1, len(val) // PAIR_CHUNK)):
                at = slice(c * PAIR_CHUNK, (c + 1) * PAIR_CHUNK)
                if cnt[at].any():
                    yield _row(c, part, texts, zlib.compress(val[at].tobytes() + cnt[at].tobytes(), 1))
            yield _row(-1, part, texts, b"")

    return run


def _unpack_pairs(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    m = len(raw) // 10
    return np.frombuffer(raw, U, m), np.frombuffer(raw, np.uint16, offset=8 * m)


def _vote_up(rows: pa.Table) -> pa.Table:
    """One piece of the table of pairs from those of several parts, in the order of the parts."""
    val = cnt = None
    for i in np.argsort(rows.column("h").to_numpy(), kind="stable"):
        v, n = _unpack_pairs(rows.column("body")[int(i)].as_py())
        if val is None:
            val, cnt = v.copy(), n.copy()
            continue
        at = np.flatnonzero(n)
        merge_pairs(val, cnt, at, v[at], n[at].astype(np.int64))
    return pa.table({"kind": rows.column("kind").slice(0, 1), "h": rows.column("grp").slice(0, 1), "body": pa.array([zlib.compress(val.tobytes() + cnt.tobytes(), 1)], pa.binary())})


def _rows_of(batches: Iterator[pa.RecordBatch], many: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
    """(count, bytes, starts, ends) of rows (n, body), batches joined up to about many bytes; a longer row comes alone."""
    wait: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        wait.append(batch)
        held += batch.column(1).nbytes
        if held >= many:
            yield _joined(wait)
            wait, held = [], 0
    if wait:
        yield _joined(wait)


def _joined(wait: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    n = np.concatenate([b.column(0).to_numpy() for b in wait])
    body = pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in wait])
    offs = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    return n, np.frombuffer(body.buffers()[2] or b"", np.uint8), offs[:-1], offs[1:]


def _positions(batches: Iterator[pa.RecordBatch], step: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """(byte with the seven before it, place, hash of all before it, count) of the vocabulary's positions, about step at once.

    Positions with the same beginning and byte are one, with the sum of their counts, as far as they stand near each other.
    """
    for n, buf, s, e in _rows_of(batches, BLOCK_BYTES):
        for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(e - s) // BLOCK_BYTES)) + 1):
            if len(some):
                w, j, ph, bounds = spelled(buf, s[some], e[some])
                at, inv = alike(w, ph)
                many = np.bincount(inv, np.repeat(n[some], np.diff(bounds)).astype(np.float64), len(at)).astype(np.int64)
                w, j, ph = w[at], j[at], ph[at]
                for a in range(0, len(w), step):
                    b = a + step
                    yield w[a:b], j[a:b], ph[a:b], many[a:b]


@tidied
def _count(k: int, size: int) -> object:
    """Bit counts of context k over rows (n, body): pieces of its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _part()
        sums = np.zeros((2, 1 << size), np.int64)
        for w, j, ph, n in _positions(batches):
            count_bits(k, w, j, ph, n, sums)
        for c in range(max(1, (1 << size) // CHUNK)):
            piece = sums[:, c * CHUNK : (c + 1) * CHUNK]
            if piece.any():
                yield _row(k * 256 + c, part, 0, zlib.compress(piece.tobytes(), 1))

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """One piece of a table of counts from those of several parts."""
    total = 0
    for body in rows.column("body"):
        total = total + np.frombuffer(zlib.decompress(body.as_py()), np.int64)
    return pa.table({"kind": rows.column("kind").slice(0, 1), "h": rows.column("grp").slice(0, 1), "body": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _merged(parts: DataFrame, n_parts: int, how: object) -> DataFrame:
    """Pieces of at most 64 parts a group become one, until one of each kind is left."""
    while True:
        n_parts = max(1, -(-n_parts // 64))
        parts = parts.withColumn("grp", F.pmod("h", F.lit(n_parts))).groupBy("kind", "grp").applyInArrow(how, "kind int, h long, body binary")
        if n_parts == 1:
            return parts


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of segments (n, body) that hold more than their last byte."""
    for n, buf, s, e in _rows_of(batches, BLOCK_BYTES):
        some = np.flatnonzero(e - s > 1)
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(buf, s[some], e[some] - 1).view(np.int64)), pa.array(n[some])], ["word", "n"])


#: what a worker unpacked last, as its tasks run one after another on the same tables
_frozen: dict[int, object] = {}


def _unpacked(key: int, make: object) -> object:
    if key not in _frozen:
        _frozen.clear()
        _frozen[key] = make()
    return _frozen[key]


def _opened(packed: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(b), np.uint16) for b in packed]


@tidied
def _learn(shared, start, key: int, total: int, rate: float) -> object:
    """Learn online over rows (n, body), some total positions, from the given model; one row with the learned one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _unpacked(key, lambda: _opened(shared.value))
        model = Model()
        model.states, w0, map0 = start.value
        model.w, model.map = w0.copy(), map0.copy()
        done = 0
        for w, j, ph, n in _positions(batches):
            a = 0
            while a < len(w):
                b = a + (STEPS[0] if done < 64 * STEPS[0] else STEPS[1])
                model.learn(w[a:b], j[a:b], ph[a:b], n[a:b], tables, rate * max(0.05, 1 - done / max(total, 1)))
                done += len(w[a:b])
                a = b
        if done:
            out = io.BytesIO()
            np.savez(out, w=model.w, map=model.map, gate_n=model.gate_n, map_n=model.map_n)
            yield _row(0, _part(), done, out.getvalue())

    return run


@tidied
def _segments_scored(shared, model, key: int) -> object:
    """(h, bits) of the vocabulary's rows (n, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _unpacked(key, lambda: Scorer(_opened(shared.value), np.zeros(1, U), np.zeros(1, np.uint16), model.value))
        for _, buf, s, e in _rows_of(batches, BLOCK_BYTES):
            for some in np.split(np.arange(len(s)), np.flatnonzero(np.diff(np.cumsum(e - s) // BLOCK_BYTES)) + 1):
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(word_hashes(buf, s[some], e[some]).view(np.int64)), pa.array(scorer.fresh(buf, s[some], e[some]))], ["h", "bits"])

    return run


@tidied
def _named(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        val, cnt = shared.value
        seen = np.zeros((4, 4, 2), np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0), BATCH_BYTES):
                see_named(val, cnt, data, offs, seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(32)), pa.array(seen.reshape(-1))], ["at", "n"])

    return run


@tidied
def _score(shared, named, scored, model, head, key: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _unpacked(key, lambda: Scorer(_opened(shared.value), *named.value, model.value, scored.value))
        known, logs, end_log, texts = head.value
        for batch in batches:
            n = len(batch)
            n_tokens, n_known, base, bits, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            rest: list[list[int]] = [[] for _ in range(n)]
            for a, b, data, offs in slices(batch.column(1), BATCH_BYTES):
                bits[a:b], size[a:b] = scorer.texts(data, offs)
                low = LOWER[data]
                s, e, first = words(low, offs, NOT_BLANK)
                u, inv = np.unique(word_hashes(low, s, e), return_inverse=True)
                i = np.searchsorted(known, u)
                i[i == len(known)] = 0
                have = known[i] == u if len(known) else np.zeros(len(u), bool)
                value = np.where(have, logs[i] if len(known) else 0, 0.0)[inv]
                got = have[inv]
                row = np.repeat(np.arange(b - a), np.diff(first))
                n_tokens[a:b] = np.diff(first) + 1
                n_known[a:b] = np.bincount(row, got, b - a).astype(np.int64) + (texts > 0)
                base[a:b] = np.bincount(row, value, b - a) + end_log
                left = np.flatnonzero(~got)
                for r, x in zip(row[left].tolist(), u[inv[left]].view(np.int64).tolist(), strict=True):
                    rest[a + r].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(bits), pa.array(size), pa.array(rest, pa.list_(pa.int64()))],
                ["id", "h", "n_tokens", "n_known", "base", "bits", "n_bytes", "rest"],
            )

    return run


def most_frequent(counts: DataFrame, limit: int) -> int:
    """The least n such that at most limit rows of counts (n) have n or more."""
    bucket = F.floor(F.log2("n") * 4).cast("int")
    hist = sorted(((r.b, r.c, r.low) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for _, c, low in hist:
        total += c
        if total > limit:
            break
        least = low
    return least


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, head_words: int = HEAD_WORDS) -> DataFrame:
    """Scores of all texts by a model of those outside the held-out fold; see the module's text."""
    # rows of the saved tables hold up to 128 KB, and a reader keeps room for whole batches
    conf = ready(docs.sparkSession).conf
    before = conf.get(_READ)
    conf.set(_READ, str(READ_ROWS))
    try:
        return _score_texts(docs, id_col, text_col, folds, head_words)
    finally:
        conf.set(_READ, before)


def _score_texts(docs: DataFrame, id_col: str, text_col: str, folds: int, head_words: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), out.alias("held_out"))
    train = d.filter(~F.col("held_out"))
    n_bytes = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = max(MIN_PARTS, -(-n_bytes // PART_BYTES))
    pair_bits = int(min(PAIRS, max(10, np.ceil(np.log2(n_bytes / 3 + 1)))))
    got = saved(train.select("text").coalesce(int(few)).mapInArrow(_gather(pair_bits), _GATHERED), "lm")
    # dealt out before rows are added up: sorting a task's whole share of segments first took most of an executor's memory
    vocabulary = saved(got.filter("kind = -2").select("h", "n", "body").repartition("h").groupBy("h").agg(F.sum("n").alias("n"), F.min("body").alias("body")), "vocabulary")
    v_bytes = vocabulary.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    sizes = table_sizes(v_bytes)
    # segments that begin alike come to one task, in order; beginnings with more than a task's share are dealt out
    ranges = int(max(MIN_PARTS, -(-v_bytes // LEARN_BYTES)))
    begin = F.substring("body", 1, 3)
    hot = [bytes(r.k) for r in vocabulary.groupBy(begin.alias("k")).agg(F.sum(F.octet_length("body")).alias("s")).filter(F.col("s") > max(1, v_bytes // (2 * ranges))).collect()]
    spread = F.when(begin.isin(hot), F.pmod("h", F.lit(8 * ranges))).otherwise(0) if hot else F.lit(0)
    ordered = vocabulary.repartition(ranges, begin, spread).sortWithinPartitions("body")
    ordered_once = saved(ordered.select("n", "body"), "ordered")

    # bit counts: a task a context, and several for a large vocabulary
    # two tasks at least, as a union of single partitions would be one task
    counters = max(2, -(-v_bytes // COUNT_BYTES))
    parts = None
    for k in range(CONTEXTS):
        one = ordered_once.coalesce(counters).mapInArrow(_count(k, sizes[k]), _GATHERED)
        parts = one if parts is None else parts.union(one)
    model = Model()
    tables = [np.zeros(1 << t, np.uint16) for t in sizes]
    for r in _merged(parts, counters, _add_up).toLocalIterator():
        k, c = divmod(r.kind, 256)
        piece = np.frombuffer(zlib.decompress(r.body), np.int64).reshape(2, -1)
        model.see_counts(k, piece)
        tables[k][c * CHUNK : (c + 1) * CHUNK] = codes(*piece)
    model.learn_states()
    shared = sc.broadcast([zlib.compress(t.tobytes(), 1) for t in tables])
    del tables
    val, cnt = np.zeros(1 << pair_bits, U), np.zeros(1 << pair_bits, np.uint16)
    for r in _merged(got.filter("kind >= 0").select("kind", "h", "body"), int(few), _vote_up).toLocalIterator():
        at = slice(r.kind * PAIR_CHUNK, (r.kind + 1) * PAIR_CHUNK)
        val[at], cnt[at] = _unpack_pairs(r.body)

    words_n = saved(vocabulary.select("n", "body").mapInArrow(_stems, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words_n.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    texts = got.filter("kind = -1").agg(F.sum("n")).first()[0] or 0
    n_all, v_all = (total.n or 0) + texts, total.v + (texts > 0)
    norm = n_all + 0.1 * (v_all + 1)
    drop_saved(got)
    least = most_frequent(words_n, head_words)
    top = words_n.filter(F.col("n") >= least).toArrow()
    known = top.column("word").to_numpy().astype(np.int64).view(U)
    order = np.argsort(known)
    logs = np.log10((top.column("n").to_numpy()[order].astype(np.float64) + 0.1) / norm)
    head = sc.broadcast((known[order], logs, float(np.log10((texts + 0.1) / norm)), texts))
    del top, known, logs, order

    # weights, gates and the adaptive map, learned over the vocabulary
    key = uuid.uuid4().int
    start = sc.broadcast((model.states, model.w, model.map))
    learned = ordered.select("n", "body").mapInArrow(_learn(shared, start, key, v_bytes // (3 * ranges), RATE), _GATHERED)
    found = []
    for r in sorted(learned.collect(), key=lambda r: r.h):
        with np.load(io.BytesIO(r.body)) as f:
            one = Model()
            one.w, one.map, one.gate_n, one.map_n = f["w"], f["map"], f["gate_n"], f["map_n"]
        found.append(one)
    model.merge(found)
    start.destroy()

    # trust in named segments, over all training texts
    named = sc.broadcast((val, cnt))
    del val, cnt
    seen = np.zeros(32)
    for r in train.select("text").mapInArrow(_named(named), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r.at] = r.n
    seen = seen.reshape(4, 4, 2)
    model.trust = np.clip((seen[..., 1] + model.trust) / (seen.sum(2) + 1), 1e-4, 0.999)

    # the most frequent segments, scored once
    learned_model = sc.broadcast(model)
    often = most_frequent(vocabulary, HEAD_SEGMENTS)
    top = ordered_once.filter(F.col("n") >= often).mapInArrow(_segments_scored(shared, learned_model, uuid.uuid4().int), "h long, bits double").select("h", F.col("bits").cast("float").alias("bits")).toArrow()
    known = top.column("h").to_numpy().astype(np.int64).view(U)
    order = np.argsort(known)
    scored = sc.broadcast((known[order], top.column("bits").to_numpy().astype(np.float32)[order]))
    del top, known, order
    drop_saved(vocabulary, ordered_once)

    rows = d.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(_score(shared, named, scored, learned_model, head, uuid.uuid4().int), f"id {d.schema['id'].dataType.simpleString()}, h long, n_tokens long, n_known long, base double, bits double, n_bytes long, rest array<long>")
    rows = saved(rows, "scores")
    # words outside the head: each is looked up in the exact counts; rows that repeat stay as many as they were
    tail = rows.select("id", "h", F.explode("rest").alias("word")).join(words_n, "word", "left").groupBy("id", "h").agg(
        F.count("n").alias("tail_known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(norm))).alias("tail_base")
    )
    tail = tail.withColumnsRenamed({"id": "tail_id", "h": "tail_h"})
    same = rows.groupBy("id", "h").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "bits", "n_bytes")))
    both = same.join(tail, F.col("id").eqNullSafe(F.col("tail_id")) & (F.col("h") == F.col("tail_h")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    return both.select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("tail_known") / F.col("k")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("tail_base") / F.col("k"), F.lit(0.0))).alias("base_score"),
        (F.col("bits") * float(np.log10(2))).alias("score"),
        "n_bytes",
        (-F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
