"""Dynamic-programming kernels on whole Arrow batches.

Strings of a batch become one padded matrix of characters; the recurrences then run over positions or anti-diagonals,
each step for all rows of the batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

#: Rows that one step works on, and bytes of a step's matrices, which bound a task's memory.
ROWS, CELLS = 1024, 64 << 20
DIAG, UP, BACK, ZERO = 0, 1, 2, 4
_LOW = np.int32(-(1 << 28))
_BEYOND = 0x110000  # no code point


def padded(texts: list[str], pad: int = 0, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of characters, padded to the longest, and their lengths; ``wide``: code points instead of bytes."""
    size, kind = np.array([len(t) for t in texts], np.int64), np.uint32 if wide else np.uint8
    out = np.full((len(texts), int(size.max(initial=0))), pad, kind)
    flat = "".join(texts)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer(flat.encode("utf-32-le", "surrogatepass") if wide else flat.encode(), kind)
    return out, size


def matrices(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both lists padded with what matches nothing, and their lengths. Bytes where all is plain ASCII, else code points,
    so that no two different letters are ever equal."""
    wide = not all(t.isascii() and "\0" not in t and "\1" not in t for t in ("".join(x), "".join(y)))
    pad = _BEYOND if wide else 0
    return *padded(x, pad, wide), *padded(y, pad + 1, wide)


def strings(chars: np.ndarray, size: np.ndarray) -> list[str]:
    """The strings of rows of ASCII characters or code points."""
    flat = chars[np.arange(chars.shape[1])[None, :] < size[:, None]].tobytes()
    text = flat.decode("utf-32-le", "surrogatepass") if chars.dtype == np.uint32 else flat.decode()
    cut = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [text[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)]


def runs(x: list[str], y: list[str], cells: Callable[[int, int], int]) -> Iterator[slice]:
    """Slices of rows whose matrices (``cells`` of the two longest, for each row) stay within bounds; rows of any
    length are served, the longest alone."""
    at = 0
    while at < len(x):
        n, a, b = 0, 0, 0
        while at + n < len(x) and n < ROWS:
            a, b = max(a, len(x[at + n])), max(b, len(y[at + n]))
            if n and (n + 1) * cells(a, b) > CELLS:
                break
            n += 1
        yield slice(at, at + n)
        at += n


def common_substring(x: list[str], y: list[str]) -> np.ndarray:
    """Rows (start in x, start in y, length) of the longest common substrings. Ties: earliest end in y, then first
    occurrence in x. Length 0 gives starts of -1."""
    out = np.full((len(x), 3), (-1, -1, 0), np.int32)
    for part in runs(x, y, lambda a, b: 8 * (a + b + 1)):
        a, _, b, _ = matrices(x[part], y[part])
        n, w, h = len(a), a.shape[1], b.shape[1]
        if not w or not h:
            continue
        kind = np.uint8 if min(w, h) < 255 else np.int32
        run, following = np.zeros((n, w + 1), kind), np.zeros((n, w + 1), kind)
        best, end_x, end_y = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(h):
            np.add(run[:, :-1], 1, out=following[:, 1:])
            np.multiply(following[:, 1:], a == b[:, j : j + 1], out=following[:, 1:])
            run, following = following, run
            top = run.max(axis=1)
            better = np.flatnonzero(top > best)
            if len(better):
                best[better], end_x[better], end_y[better] = top[better], run[better].argmax(axis=1), j + 1
        size = best.astype(np.int64)
        out[part] = np.stack([np.where(size > 0, end_x - size, -1), np.where(size > 0, end_y - size, -1), size], axis=1)
    return out


def common_subsequence(x: list[str], y: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    out = np.zeros(len(x), np.int32)
    for part in runs(x, y, lambda a, b: 8 * (a + b + 1)):
        a, _, b, _ = matrices(x[part], y[part])
        row = np.zeros((len(a), b.shape[1] + 1), np.int32)
        for i in range(a.shape[1]):
            hit = row[:, :-1] + (a[:, i : i + 1] == b)
            row[:, 1:] = np.maximum(row[:, 1:], hit)
            np.maximum.accumulate(row, axis=1, out=row)
        out[part] = row[:, -1]
    return out


class Alignment(NamedTuple):
    """Score, gapped x, gapped y and the half-open ranges of x and y."""

    score: int
    x: str
    y: str
    x_start: int
    x_end: int
    y_start: int
    y_end: int


def align(x: list[str], y: list[str], gap: int, band: int | None, local: bool) -> list[Alignment]:
    """Alignments of x (rows) with y (columns).

    Match 5, mismatch -4; globally a match after an equal pair earns 2 more, a mismatch after one costs 2 more. A gap
    costs ``gap`` and 2 more if the cell before it was reached diagonally. Diagonal goes before up (a gap in y) before
    back (a gap in x). ``band``: cells off the diagonal by more are out of reach. ``local``: diagonal moves don't fall
    below 0 and the best cell, first in row order, is traced back until 0.
    """
    half = lambda a, b: max(a, b) if band is None else min(band, max(a, b))
    out: list[Alignment] = []
    for part in runs(x, y, lambda a, b: (a + b + 1) * (half(a, b) + 1) + 16 * (a + b)):
        out += _align(x[part], y[part], gap, half(max(map(len, x[part])), max(map(len, y[part]))), local)
    return out


def _align(x: list[str], y: list[str], gap: int, k: int, local: bool) -> list[Alignment]:
    a, la, b, lb = matrices(x, y)
    n, rows, cols = len(a), a.shape[1], b.shape[1]
    # a cell (i, j) lives at its diagonal i - j, with an unreachable column at either side; a step updates every other one
    cost, kind = np.full((n, 2 * k + 3), _LOW, np.int32), np.full((n, 2 * k + 3), UP, np.uint8)
    equal = np.zeros((n, 2 * k + 3), bool)
    way = np.zeros((rows + cols + 1, n, k + 1), np.uint8)
    best, best_i, best_j = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    last, every = np.full(n, _LOW, np.int32), np.arange(n)
    for d in range(rows + cols + 1):
        lo, hi = max(1, d - cols, -((k - d) // 2)), min(rows, d - 1, (d + k) // 2)
        if lo <= hi:
            s = slice(2 * lo - d + k + 1, 2 * hi - d + k + 2, 2)
            above, before = slice(s.start - 1, s.stop - 1, 2), slice(s.start + 1, s.stop + 1, 2)
            same = a[:, lo - 1 : hi] == b[:, d - hi - 1 : d - lo][:, ::-1]
            score = np.where(same, np.int32(5), np.int32(-4))
            if not local:
                score += np.where(equal[:, s], np.where(same, np.int32(2), np.int32(-2)), np.int32(0))
            equal[:, s] = same
            c = cost[:, s] + score
            if local:
                np.maximum(c, 0, out=c)
            up = cost[:, above] - gap - 2 * (kind[:, above] == DIAG)
            left = cost[:, before] - gap - 2 * (kind[:, before] == DIAG)
            if not local and hi == d - 1:
                left[:, -1] = _LOW
            m = np.where(c < up, np.uint8(UP), np.uint8(DIAG))
            np.maximum(c, up, out=c)
            m[c < left] = BACK
            np.maximum(c, left, out=c)
            cost[:, s], kind[:, s] = c, m
            if local:
                i = np.arange(lo, hi + 1)
                seen = np.where((i[None, :] <= la[:, None]) & (d - i[None, :] <= lb[:, None]), c, 0)
                top, at = seen.max(axis=1), seen.argmax(axis=1)
                # first in row order: among equal scores the smallest row, then the smallest column
                wi, wj = i[at], d - i[at]
                better = (top > best) | ((top == best) & (top > 0) & ((wi < best_i) | ((wi == best_i) & (wj < best_j))))
                best, best_i, best_j = np.where(better, top, best), np.where(better, wi, best_i), np.where(better, wj, best_j)
                m = m | np.where(c <= 0, np.uint8(ZERO), np.uint8(0))
            way[d][:, (s.start - 1) >> 1 : ((s.start - 1) >> 1) + m.shape[1]] = m
        edge = 0 if local else -d * gap
        if d <= min(cols, k):
            cost[:, k + 1 - d], kind[:, k + 1 - d] = edge, BACK
        if 0 < d <= min(rows, k):
            cost[:, k + 1 + d], kind[:, k + 1 + d] = edge, UP
        ends = every[(d == la + lb) & (np.abs(la - lb) <= k)]
        last[ends] = cost[ends, (la - lb)[ends] + k + 1]
    i, j = (best_i.copy(), best_j.copy()) if local else (la.copy(), lb.copy())
    end_i, end_j = i.copy(), j.copy()
    ops = np.zeros((n, rows + cols + 1), np.uint8)  # from the end; 0 is none
    r, t = every[best > 0 if local else (last > _LOW // 2) & (la + lb > 0)], 0
    while len(r):
        m = way[i[r] + j[r], r, (i[r] - j[r] + k) >> 1]
        if local:
            go = (m & ZERO == 0) & (i[r] > 0) & (j[r] > 0)
            r, m = r[go], m[go]
        m = np.where(i[r] == 0, BACK, np.where(j[r] == 0, UP, m))
        ops[r, t] = m + 1
        i[r] -= m != BACK
        j[r] -= m != UP
        t += 1
        if not local:
            r = r[(i[r] > 0) | (j[r] > 0)]
    size = (ops > 0).sum(axis=1)
    at = np.arange(t)[None, :]
    shown = at < size[:, None]
    forward = np.where(shown, np.take_along_axis(ops[:, : max(t, 1)], np.clip(size[:, None] - 1 - at, 0, max(t - 1, 0)), axis=1) if t else 0, 0)
    gapped = []
    for m, start, other in ((a, i, BACK + 1), (b, j, UP + 1)):
        taken = shown & (forward != other)
        where = np.clip(start[:, None] + np.cumsum(taken, axis=1) - 1, 0, max(m.shape[1] - 1, 0))
        chars = np.where(taken, np.take_along_axis(m, where, axis=1) if m.shape[1] and t else 0, ord("-"))
        gapped.append(strings(chars.astype(m.dtype), size))
    score = best if local else last
    return list(map(Alignment, score.tolist(), *gapped, i.tolist(), end_i.tolist(), j.tolist(), end_j.tolist()))
