"""The overlay of one feature with many edges: memory does not grow with the square of the edges."""

import math
import random
import tracemalloc

import numpy as np

from geoweave.operators import union


def circle(n, x):
    return [[(x + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]]


def test_many_edges_in_bounded_memory():
    tracemalloc.start()
    (part,), overlap = union.overlay([circle(1500, 0.0), circle(1500, 0.5)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    r = part[0]
    area = float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
    lens = 2 * math.acos(0.25) - 0.25 * math.sqrt(4 - 0.25)
    assert len(part) == 1 and overlap > 0 and abs(area - (2 * math.pi - lens)) < 1e-4
    assert peak < 100e6


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    parts = [[[(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(5)]] for _ in range(8)]
    whole = union.overlay(parts)
    monkeypatch.setattr(union, "PAIRS", 7)
    small = union.overlay(parts)
    assert small[1] == whole[1] and len(small[0]) == len(whole[0])
    assert all(np.array_equal(x, y) for p, q in zip(small[0], whole[0], strict=True) for x, y in zip(p, q, strict=True))
