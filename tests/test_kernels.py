"""Kernels against plain dynamic programmes."""

from __future__ import annotations

import random

from pairloom.functions import kernels as K


def words(rng, n, top, letters="ACGT"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, top))) for _ in range(n)]


def plain_substring(x, y):
    best = (0, -1, -1)
    for end in range(1, len(y) + 1):
        for n in range(end, best[0], -1):
            at = x.find(y[end - n : end])
            if at >= 0:
                best = (n, at, end - n)
                break
    return (best[1], best[2], best[0])


def plain_subsequence(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def plain_align(x, y, gap, band, local):
    """Cells by row and column, as the rules are stated: score, way; then the path back."""
    low = -(10**9)
    cost = [[low] * (len(y) + 1) for _ in range(len(x) + 1)]
    way = [[None] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if band is not None and abs(i - j) > band:
                continue
            if i == 0 or j == 0:
                cost[i][j], way[i][j] = (0 if local else -gap * (i + j)), ("back" if i == 0 else "up")
                continue
            same = x[i - 1] == y[j - 1]
            s = 5 if same else -4
            if not local and i > 1 and j > 1 and x[i - 2] == y[j - 2]:
                s += 2 if same else -2
            c, w = cost[i - 1][j - 1] + s, "diag"
            if local:
                c = max(0, c)
            up = cost[i - 1][j] - gap - 2 * (way[i - 1][j] == "diag")
            if c < up:
                c, w = up, "up"
            if local or j > 1:
                left = cost[i][j - 1] - gap - 2 * (way[i][j - 1] == "diag")
                if c < left:
                    c, w = left, "back"
            cost[i][j], way[i][j] = c, w
    i, j = len(x), len(y)
    if local:
        top, i, j = 0, 0, 0
        for a in range(1, len(x) + 1):
            for b in range(1, len(y) + 1):
                if cost[a][b] > top:
                    top, i, j = cost[a][b], a, b
    score, gx, gy = cost[i][j], "", ""
    while (cost[i][j] > 0) if local else (i or j):
        w = "back" if i == 0 else "up" if j == 0 else way[i][j]
        gx = ("-" if w == "back" else x[i - 1]) + gx
        gy = ("-" if w == "up" else y[j - 1]) + gy
        i, j = i - (w != "back"), j - (w != "up")
    return score, gx, gy


def test_common_substring():
    rng = random.Random(1)
    x, y = words(rng, 400, 14, "ACG"), words(rng, 400, 14, "ACG")
    got = K.common_substring(x, y)
    assert [tuple(r) for r in got.tolist()] == [plain_substring(a, b) for a, b in zip(x, y, strict=True)]


def test_common_subsequence():
    rng = random.Random(2)
    x, y = words(rng, 300, 12), words(rng, 300, 15)
    assert K.common_subsequence(x, y).tolist() == [plain_subsequence(a, b) for a, b in zip(x, y, strict=True)]


def test_global_band():
    rng = random.Random(3)
    x = [w for w in words(rng, 300, 14) if w]
    y = ["".join(rng.choice("ACGT") if rng.random() < 0.2 else c for c in w) for w in x]
    for band in (3, 20):
        got = K.align(x, y, 9, band, False)
        assert [g[:3] for g in got] == [plain_align(a, b, 9, band, False) for a, b in zip(x, y, strict=True)]


def test_global_of_gapped_pairs():
    rng = random.Random(5)
    x = [w for w in words(rng, 200, 16) if len(w) > 5]
    y = [w[:3] + w[4:] + rng.choice("ACGT") for w in x]
    got = K.align(x, y, 3, 4, False)
    assert [g[:3] for g in got] == [plain_align(a, b, 3, 4, False) for a, b in zip(x, y, strict=True)]
    assert all(g[1].replace("-", "") == a and g[2].replace("-", "") == b for g, a, b in zip(got, x, y, strict=True))


def test_local():
    rng = random.Random(4)
    x, y = words(rng, 300, 14), words(rng, 300, 14)
    got = K.align(x, y, 3, None, True)
    assert [g[:3] for g in got] == [plain_align(a, b, 3, None, True) for a, b in zip(x, y, strict=True)]


def test_rows_of_very_different_length():
    x, y = ["A" * 3000, "", "ACGT"], ["A" * 2000, "ACGT", ""]
    assert K.common_substring(x, y).tolist() == [[0, 0, 2000], [-1, -1, 0], [-1, -1, 0]]
    assert K.common_subsequence(x, y).tolist() == [2000, 0, 0]
