"""The matching blocks of ``difflib.SequenceMatcher``, counted for many pairs of strings at once.

A pair's blocks are found as there: the longest common block, the earliest on ties, then the same on both sides of it. All pending parts of all pairs
take that step together, parts of like size in one array, so a character costs a few numpy operations and no Python. In strings of 200
characters or more the frequent characters start no block and only extend one, as there.

Pairs that share a group compete: a pair is dropped once all that is left of it, taken as matching, stays below the best of its group.
"""

from __future__ import annotations

import numpy as np

#: Cells of one array while blocks are searched.
CELLS = 1 << 16
#: Length from which frequent characters are set aside, as in ``difflib``.
LONG = 200
_PAD_A, _PAD_B, _FREQUENT, _LETTERS = 0, 1, 2, 3


def _encoded(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all strings as small numbers, in one byte each where there are few different ones, with each string's start and size."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    sizes = np.array([len(s) for s in strings], np.int64)
    held = np.zeros(0x110000, bool)
    held[codes] = True
    number = np.cumsum(held, dtype=np.int32) + (_LETTERS - 1)
    return number.astype(np.uint8 if number[-1] < 256 else np.int32)[codes], np.cumsum(sizes) - sizes, sizes


def _starters(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``codes`` with the frequent characters of each long string replaced."""
    out = codes.copy()
    for at, n in zip(starts[sizes >= LONG], sizes[sizes >= LONG], strict=True):
        _, which, counts = np.unique(codes[at : at + n], return_inverse=True, return_counts=True)
        out[at : at + n][counts[which] > n // 100 + 1] = _FREQUENT
    return out


def _longest(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, m: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and size of the first longest common block of each pair of ranges."""
    size, end_a, end_b = (np.zeros(len(m), np.int64) for _ in range(3))
    # Parts of like width side by side, and of like height where one width fills an array; the widest first, so that few parts make no array of their own.
    like = np.ceil(2 * np.log2(n)).astype(int)
    order = np.lexsort((m, like))[::-1]
    first = 0
    while first < len(order):
        some = order[first : first + max(1, int(CELLS / 2 ** (like[order[first]] / 2)))]
        first += len(some)
        height, width = int(m[some].max()), int(n[some].max())
        i, j = np.arange(height)[:, None], np.arange(width)[:, None]
        rows = np.where(i < m[some], a[np.minimum(at_a[some] + i, len(a) - 1)], a.dtype.type(_PAD_A))
        cols = np.where(j < n[some], b[np.minimum(at_b[some] + j, len(b) - 1)], b.dtype.type(_PAD_B))
        kind = np.uint8 if min(height, width) < 256 else np.int32
        before, now = (np.zeros((width + 1, len(some)), kind) for _ in range(2))
        best, same = np.zeros(len(some), kind), np.empty((width, len(some)), bool)
        ones = same.view(np.uint8)
        for k in range(height):
            np.equal(cols, rows[k], out=same)
            np.add(before[:-1], 1, out=now[1:])
            np.multiply(now[1:], ones, out=now[1:])
            top = now.max(0)
            if len(more := np.flatnonzero(top > best)):
                best[more] = top[more]
                end_a[some[more]], end_b[some[more]] = k + 1, now[:, more].argmax(0)
            before, now = now, before
        size[some] = best
    return end_a - size, end_b - size, size


def matched(pairs: list[tuple[str, str]], group: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Ratio of each pair, or -1 where it is below ``best`` of its group or below another pair's of the group."""
    of: dict[str, int] = {}
    one, two = (np.array([of.setdefault(p[k], len(of)) for p in pairs], np.int64) for k in (0, 1))
    codes, starts, sizes = _encoded(list(of))
    if not len(codes):
        return np.ones(len(pairs))
    right = np.unique(two)
    starters = _starters(codes, starts[right], sizes[right])
    total = sizes[one] + sizes[two]
    share = lambda count: np.where(total > 0, 2.0 * count / np.maximum(total, 1), 1.0)
    # Characters that both have, whatever their order, bound the blocks.
    held = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 64 + (codes & 63), minlength=64 * len(sizes)).reshape(-1, 64)
    most = np.minimum(held[one], held[two]).sum(1)
    done, best = np.zeros(len(pairs), np.int64), best.copy()
    alive = share(most) >= best[group]
    pid = np.flatnonzero(alive & (most > 0))
    alo, ahi, blo, bhi = np.zeros_like(pid), sizes[one[pid]], np.zeros_like(pid), sizes[two[pid]]
    while len(pid):
        base_a, base_b = starts[one[pid]], starts[two[pid]]
        i, j, k = _longest(codes, starters, base_a + alo, ahi - alo, base_b + blo, bhi - blo)
        i, j = np.where(k > 0, i, 0) + alo, np.where(k > 0, j, 0) + blo
        # Frequent characters beside a block, or at the start of both parts, extend it.
        for back in (True, False):
            go = np.flatnonzero(sizes[two[pid]] >= LONG)
            while len(go):
                go = go[(i[go] > alo[go]) & (j[go] > blo[go])] if back else go[(i[go] + k[go] < ahi[go]) & (j[go] + k[go] < bhi[go])]
                step = -1 if back else k[go]
                go = go[codes[base_a[go] + i[go] + step] == codes[base_b[go] + j[go] + step]]
                if back:
                    i[go], j[go] = i[go] - 1, j[go] - 1
                k[go] += 1
        np.add.at(done, pid, k)
        hit = k > 0
        pid, alo, ahi, blo, bhi = (
            np.concatenate([x[hit], y[hit]]) for x, y in ((pid, pid), (alo, i + k), (i, ahi), (blo, j + k), (j, bhi))
        )
        part = (alo < ahi) & (blo < bhi)
        pid, alo, ahi, blo, bhi = pid[part], alo[part], ahi[part], blo[part], bhi[part]
        left = np.bincount(pid, np.minimum(ahi - alo, bhi - blo), len(pairs)).astype(np.int64)
        np.maximum.at(best, group[alive], share(done)[alive])
        alive &= share(np.minimum(done + left, most)) >= best[group]
        pid, alo, ahi, blo, bhi = (x[alive[pid]] for x in (pid, alo, ahi, blo, bhi))
    return np.where(alive, share(done), -1.0)
