"""Hash-compared suffix sort over a bounded set of byte contexts.

Prefix polynomial hashes give the hash of any substring in two look-ups; binary search on them finds the common extension of
two suffixes in a logarithmic number of comparisons, and a bottom-up mergesort orders the suffixes of each group with that
comparison. All groups are sorted at once, one vector operation per step. Hashes only steer: every pair of neighbours in a sorted order is
compared on the bytes themselves, which proves both the order and each equality; should a hash have lied, that order is made again on
the bytes.

The contexts of a group share an anchor at known offsets. A context stands for the window starts anchor - d, lo <= d <= hi,
and what is asked is for which d the window of ``length`` bytes also starts at another context of the group. The range of d is
halved step by step: sorted by the suffix at the range's right end, contexts that lack a neighbour with the bytes common to all windows
of the range drop out, and sorted by the suffix at their left end, those with a neighbour equal over all windows are settled.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Odd, so it has an inverse modulo 2^64.
RADIX = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
VALUES = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the radix and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """h[i] is the polynomial hash of the first i bytes, modulo 2^64."""
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUES[b] * powers(len(b))[0][: len(b)], out=h[1:])
    return h


class Suffixes:
    """Suffixes of a buffer, compared by hashed common extensions."""

    def __init__(self, buffer: bytes):
        self.raw = buffer
        self.b = np.frombuffer(buffer, np.uint8)
        self.h = prefix_hashes(self.b)
        self.inv = powers(len(self.b))[1]

    def lcp(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at ``x`` and ``y``, up to ``most``."""
        h, inv = self.h, self.inv
        hx, hy, ix, iy = h[x], h[y], inv[x], inv[y]
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = ((h[x + mid] - hx) * ix == (h[y + mid] - hy) * iy) & open_
            low = np.where(same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, end_x: np.ndarray, end_y: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(np.minimum(end_x - x, end_y - y), limit)
        n = self.lcp(x, y, most)
        stop = n >= most
        last = len(self.b) - 1
        cx, cy = self.b[np.minimum(x + n, last)], self.b[np.minimum(y + n, last)]
        size_x, size_y = np.minimum(end_x - x, limit), np.minimum(end_y - y, limit)
        return np.where(stop, (size_x < size_y) | ((size_x == size_y) & or_equal), cx < cy)

    def sort(self, pos: np.ndarray, end: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
        """Order that sorts the entries by group and then by the suffix at ``pos`` (bytes up to ``end``, ``limit`` at most)."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        start, n = np.repeat(first, size), np.repeat(size, size)
        run, largest = 1, int(size.max(initial=0))
        while run < largest:
            at = np.arange(len(order)) - start
            mine = at // run
            other = mine ^ 1
            low0 = np.minimum(other * run, n)
            low, high = start + low0, start + np.minimum(low0 + run, n)
            active = np.flatnonzero(low < high)
            a, lo, hi = active, low[active], high[active]
            left = (mine[active] & 1) == 0
            me = order[a]
            while len(go := np.flatnonzero(lo < hi)):
                mid = (lo[go] + hi[go]) >> 1
                it = order[mid]
                # A left entry goes before its equals in the right run, a right entry after those in the left one.
                before = self.less(pos[it], pos[me[go]], end[it], end[me[go]], limit, ~left[go])
                lo[go] = np.where(before, mid + 1, lo[go])
                hi[go] = np.where(before, hi[go], mid)
            rank = np.zeros(len(order), np.int64)
            rank[active] = lo - low[active]
            pair = (mine & ~1) * run
            to = start + pair + (at - mine * run) + rank
            new = np.empty_like(order)
            new[to] = order
            order = new
            run *= 2
        return order

    def classes(self, pos: np.ndarray, end: np.ndarray, group: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Class of each entry: entries of a group that agree in their first ``length`` bytes; -1 for entries shorter than that.

        Entries of a group must ask for the same length.
        """
        out = np.full(len(pos), -1, np.int64)
        use = np.flatnonzero(end - pos >= length)
        if not len(use):
            return out
        p, e, g, n = pos[use], end[use], group[use], length[use]
        raw = self.raw
        bodies = [raw[i : i + k] for i, k in zip(p.tolist(), n.tolist(), strict=True)]
        order = self.sort(p, p + n, g, int(n.max()))
        same = _proved(bodies, g, order)
        if same is None:
            order = np.array(sorted(range(len(p)), key=lambda i: (g[i], bodies[i])))
            same = _proved(bodies, g, order)
        out[use[order]] = np.concatenate([[0], np.cumsum(~same)])
        return out


def _proved(bodies: list[bytes], group: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """Which neighbours of ``order`` are of one group and equal; None if the order is not that of the bytes."""
    same = np.zeros(max(0, len(order) - 1), bool)
    g, at = group[order].tolist(), order.tolist()
    for i in range(len(same)):
        if g[i] == g[i + 1]:
            x, y = bodies[at[i]], bodies[at[i + 1]]
            if x == y:
                same[i] = True
            elif x > y:
                return None
    return same


def repeated_starts(group: np.ndarray, bodies: list[bytes], low: np.ndarray, high: np.ndarray, settled: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of d whose window starts in another context of its group too.

    ``bodies[i]`` holds the windows at d = high[i] (its first byte) down to low[i]; ``settled`` contexts are known to repeat
    throughout and serve as partners only.
    """
    s = Suffixes(b"".join(bodies))
    size = np.array([len(b) for b in bodies], np.int64)
    stop = np.cumsum(size)
    anchor = stop - size + high
    found: list[list[tuple[int, int]]] = [[] for _ in bodies]
    mem, j, done, cls = np.arange(len(bodies)), np.zeros(len(bodies), np.int64), settled.copy(), group.astype(np.int64)
    width = 1 << int(max(1, high.max(initial=0) + 1) - 1).bit_length()
    while len(mem) and width:
        d0 = j * width
        lo, hi = np.maximum(low[mem], d0), np.minimum(high[mem], d0 + width - 1)
        core = length - (width - 1)
        _, key = np.unique(np.stack([cls, j]), axis=1, return_inverse=True)
        if core > 0 and width > 1:
            key = s.classes(anchor[mem] - d0, stop[mem], key.ravel(), np.full(len(mem), core))
        key = key.ravel()
        keep = _shared(key, ~done)
        mem, j, done, key, lo, hi = mem[keep], j[keep], done[keep], key[keep], lo[keep], hi[keep]
        if not len(mem):
            break
        _, full = np.unique(np.stack([key, lo, hi]), axis=1, return_inverse=True)
        same = s.classes(anchor[mem] - hi, stop[mem], full.ravel(), length + hi - lo)
        twice = np.bincount(same[same >= 0], minlength=1)[np.maximum(same, 0)] >= 2
        twice &= same >= 0
        for i in np.flatnonzero(twice & ~done):
            found[mem[i]].append((int(lo[i]), int(hi[i])))
        done = done | twice
        keep = _shared(key, ~done)
        mem, j, done, key = mem[keep], j[keep], done[keep], key[keep]
        width >>= 1
        if not width:
            break
        mem, j, done, cls = np.tile(mem, 2), np.concatenate([2 * j, 2 * j + 1]), np.tile(done, 2), np.tile(key, 2)
        inside = (low[mem] <= j * width + width - 1) & (high[mem] >= j * width)
        mem, j, done, cls = mem[inside], j[inside], done[inside], cls[inside]
    return found


def _shared(key: np.ndarray, undecided: np.ndarray) -> np.ndarray:
    """Entries of classes with two members or more of which one at least is undecided."""
    if not len(key):
        return np.zeros(0, bool)
    k = np.maximum(key, 0)
    n = np.bincount(k[key >= 0], minlength=k.max() + 1)
    u = np.bincount(k[(key >= 0) & undecided], minlength=k.max() + 1)
    return (key >= 0) & (n[k] >= 2) & (u[k] >= 1)
