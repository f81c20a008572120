"""Similarity of crops of unequal size against loops over pixels."""

import math

import numpy as np
import pytest

from tessera.operators import sized_crops


def resampled(b, h, w):
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * len(b) / h, (i + 1) * len(b) / h, j * len(b[0]) / w, (j + 1) * len(b[0]) / w
            for y in range(math.floor(y0), min(len(b), math.ceil(y1))):
                for x in range(math.floor(x0), min(len(b[0]), math.ceil(x1))):
                    out[i, j] += b[y][x] * max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x)) / ((y1 - y0) * (x1 - x0))
    return out


def blurred(a):
    p = np.pad(a, 1, mode="reflect")
    return sum(p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] * (2 - abs(dy)) * (2 - abs(dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 16


def score(a, b):
    if a.shape == b.shape and (a == b).all():
        return 1.0
    b = blurred(resampled(b.tolist(), *a.shape))
    a = blurred(a)
    if a.std() < 1e-6 or b.std() < 1e-6:
        return float(abs(a.mean() - b.mean()) < 1)
    return np.corrcoef(a.ravel(), b.ravel())[0, 1]


def test_sized_pairs(spark):
    rng = np.random.default_rng(11)
    grey = lambda h, w: rng.integers(0, 256, (h, w)).astype(float)
    first = [grey(rng.integers(3, 14), rng.integers(3, 14)) for _ in range(25)] + [np.full((5, 5), 9.0), np.full((5, 6), 200.0)]
    other = [np.kron(a, np.ones((2, 2))) for a in first[:12]] + [grey(rng.integers(3, 14), rng.integers(3, 14)) for _ in range(15)] + [first[0], np.full((6, 6), 9.4)]
    schema = "topic string, id long, width int, height int, pixels array<double>"
    table = lambda cs: spark.createDataFrame([("t", i, c.shape[1], c.shape[0], c.ravel().tolist()) for i, c in enumerate(cs)] + [("t", 90, 4, 4, None), ("t", 91, 4, 4, [1.0]), ("t", 92, 0, 4, []), ("u", 93, 4, 4, [float(i) for i in range(16)]), ("t", 94, 4, 4, [None] * 16)], schema)
    got = {(r.topic, r.m, r.t): r.score for r in sized_crops.sized_pairs(table(first), table(other), ["topic"], "id").collect()}
    want = {("u", 93, 93): 1.0}
    for i, a in enumerate(first):
        for j, b in enumerate(other):
            r = (a.shape[1] / a.shape[0]) / (b.shape[1] / b.shape[0])
            if min(*a.shape, *b.shape) >= 4 and max(r, 1 / r) <= 1.35:
                want["t", i, j] = score(a, b)
    assert got.keys() == want.keys() and len(got) > 100
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6), k
    assert got["t", 25, 28] == 1.0 and all(got["t", i, i] > 0.9 for i in range(12) if ("t", i, i) in got)
