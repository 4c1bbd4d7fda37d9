"""Context-tree weighting over bytes, as array code on sorted byte n-grams.

A *gram* of depth D is one byte together with the D bytes before it, packed into an
unsigned 64-bit integer: nearest context byte first, the byte itself last. Sorting grams
therefore sorts the context tree, and a node of the tree (a context of d bytes plus the
first k bits of the next byte) is a run of neighbouring grams. Each node holds how often
its next bit was 0 and 1; its Krichevsky-Trofimov (KT) estimate is mixed with that of the
nodes one context byte deeper, with equal prior weight on stopping and going on.

A *bucket* is a set of whole subtrees below depth ``TOP`` (all grams that share their first
``TOP + 1`` context bytes are in one bucket), so buckets are computed apart. What lies above
is small and shared: ``top_levels``.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
TOP = 1  # depths 0..TOP are the shared top of the tree
END = 0xFF  # never occurs in UTF-8: ends a text and fills the context before its start
_LOG_HALF = float(np.log(0.5))
_LOG_PI = float(np.log(np.pi))


def grams_of(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One gram per byte of ``data[depth:]``; the first ``depth`` bytes are context only."""
    n = max(len(data) - depth, 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # the eight bytes from each place on as one number: the context, farthest byte lowest, then the byte
    wide = np.ndarray(n, "<u8", padded, strides=(1,)).astype(np.uint64)
    return (wide & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (wide >> np.uint64(8 * depth)) & np.uint64(0xFF)


def joined(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array, each ended by END and preceded by ``depth`` END bytes of
    context, with the number of grams (bytes + 1) of each text. The END of one text serves
    as context of the next; the ``depth - 1`` filler positions are dropped by ``keep``."""
    gap = bytes([END]) * depth
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), dtype=np.uint8)
    return data, np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def text_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts in order, and the number of grams of each text."""
    data, sizes = joined(texts, depth)
    grams = grams_of(data, depth)
    if depth > 1 and len(texts):
        starts = np.concatenate([[0], np.cumsum(sizes[:-1] + depth - 1)])
        keep = np.ones(len(grams), dtype=bool)
        for j in range(depth - 1):
            keep[starts + sizes + j] = False
        grams = grams[keep]
    return grams, sizes


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys; keys come out sorted."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = _firsts(k)
    return k[first], np.add.reduceat(c, first) if len(c) else c


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: shift by 8, then Stirling's series."""
    z = x + 8.0
    shift = np.zeros_like(z)
    for j in range(8):
        shift += np.log(x + j)
    r = 1.0 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT block probability of that many zeros and ones."""
    a, b = zeros.astype(np.float64), ones.astype(np.float64)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - _LOG_PI


def _context(grams: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Grams of depth ``depth`` cut to their ``d`` nearest context bytes."""
    if d == depth:
        return grams
    keep = grams >> np.uint64(8 * (depth - d + 1)) if d else np.zeros_like(grams)
    return (keep << np.uint64(8)) | (grams & np.uint64(0xFF))


class Level:
    """The nodes of one context depth and one bit position, sorted by key."""

    __slots__ = ("keys", "zeros", "ones", "log_pw", "stop")

    def __init__(self, keys, zeros, ones):
        self.keys, self.zeros, self.ones = keys, zeros, ones


def _level(grams: np.ndarray, counts: np.ndarray, k: int) -> Level:
    node = grams >> np.uint64(8 - k)
    first = _firsts(node)
    bit = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
    total = np.add.reduceat(counts, first)
    ones = np.add.reduceat(counts * bit, first)
    return Level(node[first], total - ones, ones)


def _parent(keys: np.ndarray, d: int, k: int) -> np.ndarray:
    """Node key one context byte shorter (from depth d to d - 1) at bit position k."""
    low = np.uint64((1 << k) - 1)
    return ((keys >> np.uint64(k + 8)) << np.uint64(k)) | (keys & low)


def _sum_at(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n)


class Tree:
    """Depths ``low``..``high`` of the tree, from counts of grams of depth ``high``.

    ``children`` (top of the tree only) holds per bit position the sums of log P_w of the
    nodes one level below ``high``, aligned with the keys of ``high``.
    """

    def __init__(self, grams, counts, high: int, low: int, children: list | None = None):
        self.high, self.low = high, low
        self.levels: dict[tuple[int, int], Level] = {}
        for d in range(high, low - 1, -1):
            cut = _context(grams, high, d)
            if d == high:
                g, c = cut, counts
            else:
                g, c = merged([cut], [counts])
            for k in range(8):
                self.levels[d, k] = _level(g, c, k)
        for k in range(8):
            for d in range(high, low - 1, -1):
                lv = self.levels[d, k]
                log_pe = log_kt(lv.zeros, lv.ones)
                if d == high and children is None:
                    lv.log_pw, lv.stop = log_pe, np.ones(len(lv.keys))
                    continue
                if d == high:
                    below = children[k]
                else:
                    deep = self.levels[d + 1, k]
                    at = np.searchsorted(lv.keys, _parent(deep.keys, d + 1, k))
                    below = _sum_at(at, deep.log_pw, len(lv.keys))
                lv.log_pw = np.logaddexp(log_pe, below) + _LOG_HALF
                lv.stop = np.exp(np.minimum(log_pe + _LOG_HALF - lv.log_pw, 0.0))

    def bit_probability(self, grams: np.ndarray, depth: int, k: int, deeper=None) -> np.ndarray:
        """Probability of bit k of each gram (of context depth ``depth``), given the
        probability by the part of the tree deeper than ``high`` (0.5 at its end)."""
        bit = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        p = np.full(len(grams), 0.5) if deeper is None else deeper
        for d in range(self.high, self.low - 1, -1):
            lv = self.levels[d, k]
            node = _context(grams, depth, d) >> np.uint64(8 - k)
            if not len(lv.keys):
                p = np.full(len(grams), 0.5)
                continue
            at = np.minimum(np.searchsorted(lv.keys, node), len(lv.keys) - 1)
            seen = lv.keys[at] == node
            hits = np.where(bit, lv.ones[at], lv.zeros[at])
            kt = (hits + 0.5) / (lv.ones[at] + lv.zeros[at] + 1.0)
            stop = lv.stop[at]
            p = np.where(seen, stop * kt + (1.0 - stop) * p, 0.5)
        return p


def top_levels(grams, counts, children) -> Tree:
    """The shared top (depths TOP..0), from counts of grams of depth TOP and, per bit
    position, sums of log P_w of the subtrees below."""
    return Tree(grams, counts, TOP, 0, children)


def log10_probability(grams, depth: int, bucket: Tree, top: Tree) -> np.ndarray:
    """log10 of the probability of each gram's byte given its context."""
    out = np.zeros(len(grams))
    for k in range(8):
        p = bucket.bit_probability(grams, depth, k)
        out += np.log10(top.bit_probability(grams, depth, k, p))
    return out
