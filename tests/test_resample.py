"""R5 by scale: target cells from the pixels' side, against the definition; nothing but the extents is broadcast, gaps cost nothing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweave.operators import raster

OFFSETS = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}
SCHEMA = "raster string, band int, row long, col long, value double"


def weight(kind, d):
    a = abs(d)
    if kind == "nearest":
        return 1.0
    if kind == "bilinear":
        return max(1 - a, 0.0)
    return 1.5 * a**3 - 2.5 * a * a + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2 if a < 2 else 0.0


def half_up(x):
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


def brute(pixels, scale, kind):
    """Every target cell of the extent's grid takes its source neighbours."""
    out, base = {}, half_up if kind == "nearest" else math.floor
    for key in {p[:2] for p in pixels}:
        own = [p for p in pixels if p[:2] == key]
        rows, cols = (math.ceil((max(p[i] for p in own if p[i] is not None) + 1) * scale) for i in (2, 3))
        at = {}
        for _, _, r, c, v in own:
            if None not in (*key, r, c, v):
                at.setdefault((r, c), []).append(v)
        for t in range(rows):
            for u in range(cols):
                sr, sc = (t + 0.5) / scale - 0.5, (u + 0.5) / scale - 0.5
                hit = [(weight(kind, base(sr) + i - sr) * weight(kind, base(sc) + j - sc), v) for i in OFFSETS[kind] for j in OFFSETS[kind]
                       for v in at.get((base(sr) + i, base(sc) + j), ())]
                if sum(w for w, _ in hit):
                    out[(*key, t, u)] = sum(w * v for w, v in hit) / sum(w for w, _ in hit)
    return out


@pytest.mark.parametrize("kind", OFFSETS)
@pytest.mark.parametrize("scale", [0.5, 0.3, 1.0, 2.0, 2.7])
def test_resampling_is_its_definition(spark, monkeypatch, kind, scale):
    """Holes, NULL pixels, NULL keys and rows that come twice; rasters of unlike sizes, broadcast or shuffled."""
    draw = random.Random(7)
    pixels = [(name, band, r, c, draw.choice([None, draw.random()]) if draw.random() < 0.2 else draw.random())
              for name, band, h, w in (("a", 1, 5, 7), ("a", 2, 9, 2), ("b", 1, 1, 3)) for r in range(h) for c in range(w) if draw.random() < 0.8]
    pixels += [("a", 1, 2, 3, 4.0), ("a", 1, 2, 3, 4.0), (None, 1, 0, 0, 1.0), ("a", 1, None, 11, 1.0)]
    want, df = brute(pixels, scale, kind), spark.createDataFrame(pixels, SCHEMA)
    for few in (raster.FEW_RASTERS, 0):
        monkeypatch.setattr(raster, "FEW_RASTERS", few)
        got = {tuple(r)[:4]: r.value for r in raster.warp(df, scale, kind).collect()}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_unknown_kernels_are_refused(spark):
    with pytest.raises(ValueError):
        raster.warp(spark.createDataFrame([], SCHEMA), 0.5, "cubicspline")


def test_rows_far_apart_are_resampled(spark):
    far = 2 * 10**12
    df = spark.createDataFrame([("a", 1, r, c, float(c)) for r in (0, far) for c in range(4)], SCHEMA)
    assert sorted((r.row, r.col, r.value) for r in raster.warp(df, 0.5).collect()) == [(t, u, 2 * u + 0.5) for t in (0, far // 2) for u in (0, 1)]


def test_only_extents_are_broadcast(spark):
    """A file of few bytes holds many pixels, so a guess from bytes must not send them, nor the target cells, through the driver."""
    pixels = spark.range(400).select(F.lit("r").alias("raster"), F.lit(1).alias("band"), F.floor(F.col("id") / 20).alias("row"),
                                     (F.col("id") % 20).alias("col"), F.lit(1.0).alias("value"))
    half = raster.warp(pixels, 0.5)
    assert len(half.collect()) == 100
    plan = half._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [i for i, x in enumerate(plan) if "BroadcastExchange" in x]
    assert sent
    for i in sent:
        under = [x for x in plan[i + 1:] if x.find("+-") > plan[i].find("+-") or x.find(":-") > plan[i].find("+-")]
        assert "Aggregate" in " ".join(under) and "Generate" not in " ".join(under)
